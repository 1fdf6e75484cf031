import hashlib
import itertools
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import audit, pii, queries, whiten

from .conftest import words

# --- 11: personal data -----------------------------------------------------------------------------------

EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    """The patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    checksum = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 12 <= len(digits(s)) <= 19 and checksum(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    found = [(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in re.finditer(p, text) if good[k](m.group())]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns_match_their_statement():
    rng = random.Random(1)
    alphabet = "aZ9@.+-() 0123456789..@@é\n_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [" ".join(rng.choice([pii.example(rng.choice(pii.KINDS), rng), pii.decoy(rng), "x", "1.2.3.4.5.6.7.8.9", "a@b.c@d.e", "@a.b", "+1+2 345 678 9012 ", "4111 1111 1111 1111 4111"]) for _ in range(8)) for _ in range(500)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_patterns_take_linear_time():
    for t in ("z" * 300_000, "7" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 150_000):
        pii.base_spans(t)
        pii.window_starts(t)


def test_every_valid_span_lies_in_a_decoded_window():
    rng = random.Random(2)
    for _ in range(3000):
        kind = rng.choice(pii.KINDS)
        span, before = pii.example(kind, rng), "x" * rng.randrange(400)
        if pii.valid(kind, span) and len(span) <= pii.WINDOW - pii.STRIDE:
            text = f"{before} {span} {'y' * 300}"
            at = len(before) + 1
            assert any(s <= at - 1 and at + len(span) + 1 <= s + pii.WINDOW for s in pii.window_starts(text)) or any(s <= at and at + len(span) <= s + pii.WINDOW for s in pii.window_starts(text))


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    w = {k: a.astype(np.float64) for k, a in pii.new_weights(rng).items()}
    x, tags = rng.integers(0, pii.VOCABULARY, (7, 3)), np.array([[0, 1, 0, 3, 4, 4, 0], [1, 2, 2, 0, 0, 5, 6], [0] * 7]).T
    loss, grads = pii.gradients(w, x, tags)
    brute = []
    for n in range(3):  # all paths, for the partition function
        e, move = pii.emissions(w, x)[:, n], w["moves"] + pii.ALLOWED
        total = e[0].astype(float)
        for t in range(1, 7):
            total = np.log(np.exp(total[:, None] + move).sum(0)) + e[t]
        p = tags[:, n]
        brute.append(np.log(np.exp(total).sum()) - e[np.arange(7), p].sum() - move[p[:-1], p[1:]].sum())
    assert abs(np.mean(brute) - loss) < 1e-3
    for k, at in (("table", (0, x[2, 1], 5)), ("table", (1, x[3, 0], 45)), ("back", (0, 3, 30)), ("back", (1, 2, 70)), ("out", (4, 3)), ("out", (25, 1)), ("bias", (2,)), ("moves", (0, 1))):
        value, eps, ends = w[k][at], 5e-2 if k == "back" else 2e-2, []
        for d in (eps, -eps):
            w[k][at] = value + d
            ends.append(pii.gradients(w, x, tags)[0])
        w[k][at] = value
        assert abs((ends[0] - ends[1]) / (2 * eps) - grads[k][at]) < 2e-3 + 0.05 * abs(grads[k][at]), (k, at)


def test_viterbi_and_reconciling_match_brute_force():
    rng = np.random.default_rng(5)
    e, move = rng.normal(size=(4, 6, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
    got = pii.viterbi(e, move)
    score = lambda p, n: sum(e[t, n, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    for n in range(6):
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: score(p, n))
        assert tuple(got[:, n]) == best
    for _ in range(200):
        spans = {(int(rng.integers(4)), int(a), int(a) + int(rng.integers(1, 6))): float(rng.normal()) for a in rng.integers(0, 20, 7)}
        apart = lambda s: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(s, 2))
        want = max(sum(spans[s] for s in some) for r in range(8) for some in itertools.combinations(spans, r) if apart(some))
        got = pii.reconcile(spans)
        assert apart([(0, a, b) for _, a, b, _ in got]) and abs(sum(o for *_, o in got) - want) < 1e-9


@pytest.fixture(scope="module")
def tagger(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return pii.fit(pii.labelled_examples(texts))


def test_tagger_finds_held_out_spans(spark, tagger):
    """Of spans in texts it was not fitted to, most are found exactly, and little else."""
    examples = pii.labelled_examples(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3"), rows=700, seed=99).collect()
    hit = want = extra = given = 0
    for r, found in zip(examples, pii.all_spans([r.text for r in examples], tagger)):
        known = {(s.kind, s.start, s.end) for s in r.spans}
        usable = {s for s in known if pii.valid(s[0], r.text[s[1] : s[2]])} - set(plain(r.text))
        got = {(k, a, b) for k, a, b, base, _ in found if not base}
        hit, want, extra, given = hit + len(got & usable), want + len(usable), extra + len(got - known), given + len(got)
    assert want > 200 and hit >= 0.9 * want and extra <= 0.05 * given, (hit, want, extra, given)


def test_spans_and_digests(spark, docs, empty, tagger):
    long = words(random.Random(3), 40_000) + " call (017) 555-7713 or +1 (017) 555-7713, ann.lee@mail3.example.com "
    texts = ["mail pavel.31[at]mail3[dot]example[dot]org now", "", None, "ip 10.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111", long, long, "é\U0001f600 bo@x.y.z"]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, texts[3], None, None)], "doc_id long, text string, pii string, n_email int").repartition(3)
    found = {r.doc_id: r for r in pii.find(df, tagger).collect()}
    assert pii.find(df, tagger).columns == ["doc_id", "text", "docs_pii", "n_email", "pii"] and len(found) == 8
    for r in found.values():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == plain(r.text or "") and r.docs_pii in ("clash", None)
    assert found[4].pii == found[5].pii and any(not s.base and s.kind == "phone" and long[s.start : s.end] == "(017) 555-7713" for s in found[4].pii)
    assert [(s.kind, texts[0][s.start : s.end]) for s in found[0].pii] == [("email", "pavel.31[at]mail3[dot]example[dot]org")]
    for r in pii.digests(df, tagger).collect():
        base = plain(texts[3 if r.doc_id is None else r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(","))
    shown = {r.doc_id: r.redacted for r in pii.redact(df, tagger).collect()}
    assert shown[0] == "mail [EMAIL] now" and shown[2] is None and shown[3] == "ip [IP] and 300.1.1.1, card [CARD]" and shown[6] == "é\U0001f600 [EMAIL]"
    assert pii.digests(empty, tagger).count() == 0 and pii.fit(pii.labelled_examples(empty)) is None
    assert pii.digests(docs, None).count() == docs.count()


# --- 12: filter audit ------------------------------------------------------------------------------------


def audited(rows, labels):
    """The audit by applying the filters to every row, order by order."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = []
    for i, source, text in rows:
        t = text or ""
        w = split(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in t for c in "#$%&*|")}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows)
        fails.append((source or "", {k for k, v in f.items() if v}, (i, "q") in labels, (i, "t") in labels))
    out, shapley = {}, defaultdict(int)
    for order in itertools.permutations("ABCDE"):
        for part in {f[0] for f in fails}:
            here = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [f for f in here if x in f[1] and not f[1] & before]
                kept = sum(not f[1] & (before | {x}) for f in here)
                out[part, "".join(order), step] = [kept, len(gone), sum(x in f[1] and bool(f[1] & before) for f in here), sum(f[1] == {x} for f in here), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_walk_visits_all_orders_by_neighbours():
    for k in range(1, 6):
        seen = list(audit.walk(k))
        assert len({tuple(o) for o, _ in seen}) == len(seen) == len(list(itertools.permutations(range(k))))
        for (a, _), (b, at) in zip(seen, seen[1:]):
            assert a[:at] == b[:at] and a[at + 2 :] == b[at + 2 :] and a[at] == b[at + 1] and a[at + 1] == b[at]


def test_audit_matches_brute_force(spark):
    rng = random.Random(6)
    texts = [words(rng, 220, 5000), words(rng, 250, 30), words(rng, 20).upper(), words(rng, 230, 5000) + " a|b", "", None, "# " * 300, words(rng, 20_000, 9000)]
    rows = [(i, rng.choice(["a", "b", "", None]), rng.choice(texts)) for i in range(60)] + [(None, "a", texts[0]), (None, "a", texts[0]), (3, "a", texts[0]), (3, "b", texts[0])]
    rows.append(rows[5])
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    marks = {(i, "q") for i, q, _ in labels if q == 1 and i is not None} | {(i, "t") for i, _, t in labels if t == 1 and i is not None}
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, text string, part string, mask int").repartition(3)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audited(rows, marks) and len(got) == 3 * 600
    assert audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_matches_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = c.execute(queries.SQL["op12_filter_audit"]).df()
    got = queries.op12_filter_audit(spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    order = ["part", "filter_order", "step"]
    assert got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()


# --- 13: whitening ---------------------------------------------------------------------------------------


def check_whitened(rows, vectors, count=8):
    """Against a full eigendecomposition; rows as of whiten()."""
    x = np.array([[int(np.floor(1024.0 * float(np.float32(v)))) + 100000 for v in vec] for vec in vectors.values()])
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, e = np.linalg.eigh(c.T @ c / n)
    values, e = values[::-1], e[:, ::-1]
    want = c @ e / np.sqrt(np.maximum(values, 1e-300))
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for i, row in zip(vectors, x)}
    at = {i: k for k, i in enumerate(vectors)}
    got = np.zeros((n, count))
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
        got[at[r.vec_id], r.component - 1] = r.whitened
    for k in range(count):
        sign = np.sign((got[:, k] * want[:, k]).sum())
        assert np.abs(got[:, k] * sign - want[:, k]).max() < 1e-6, k
    assert len(rows) == n * count


def test_whitening_of_a_table_expands_to_all_dimensions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    check_whitened(whiten.whiten(df).collect(), vectors)
    rows = whiten.whole_vectors(df)
    assert whiten.components(rows, *whiten.means(rows))["expanded"]


def test_whitening_of_a_steep_spectrum_needs_no_expansion(spark):
    rng = np.random.default_rng(8)
    data = (rng.normal(size=(300, 40)) * 50.0 ** -np.arange(40.0).clip(0, 9)[None, :]) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    data = np.round(data * 2**30) / 2**30 * 1e5
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(data)], "vec_id long, embedding array<double>")
    rows = whiten.whole_vectors(df)
    n, sums = whiten.means(rows)
    found = whiten.components(rows, n, sums, count=3)
    x = np.array([r.x for r in rows.collect()], float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert not found["expanded"] and found["passes"] <= 4 and np.allclose(found["values"], values[:3], rtol=1e-10)


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(9)
    good = {i: [float(v) for v in rng.normal(size=12)] for i in range(200)}
    good[201] = good[7]
    bad = [(300, None), (301, []), (302, [1.0] * 11 + [None]), (303, [1.0] * 11 + [float("nan")]), (304, [float("inf")] * 12), (305, [1.0] * 5), (306, [1e30] * 12)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in [*good.items(), *bad]], "vec_id long, embedding array<float>, x string").repartition(4)
    check_whitened(whiten.whiten(df).collect(), good)
    assert whiten.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")
    assert whiten.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [3.0, 6.0, 5.0])] * 2, "vec_id long, embedding array<double>")
    out = whiten.whiten(line).collect()
    assert {r.component for r in out} == {1} and len(out) == 11 and abs(out[0].explained - 1) < 1e-9
    far = spark.createDataFrame([(i, [float(i) * 2.0**38, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [r.deviation for r in sorted(whiten.whiten(far).collect(), key=lambda r: r.vec_id)] == [None, 0, None]
    assert [r.whitened for r in whiten.whiten(far).where(F.col("vec_id") == 1).collect()] == [0.0]
