import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontam, license, license_texts, lm, neardup, quality, substring
from tidewell.llm.common import mix64, span_hashes, text_buffers, word_spans

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall(text or "")


def test_word_spans_and_hashes():
    texts = ["a b", "", None, " b\ta ", "été a"]
    data, offsets = text_buffers(pa.array(texts))
    starts, ends, first = word_spans(data, offsets)
    found = [[bytes(data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
    assert found == [split(t) for t in texts]
    h = dict(zip([w for t in found for w in t], span_hashes(data, starts, ends)))
    assert len(set(h.values())) == 3 and list(span_hashes(data, starts, ends)).count(h["a"]) == 3


# --- 6: repeated passages ------------------------------------------------------------------------


def removed(rows):
    seen = Counter()
    for _, t in rows:
        w = split(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, substring.digests(docs).collect()), key=str) == removed(rows)
    assert substring.digests(empty).count() == 0
    out = substring.remove_repeats(docs.withColumnsRenamed({"key": "chunk", "size": "word"}))
    assert out.columns == ["doc_id", "text", "source", "chunk", "word"] and out.where("chunk = 'clash'").count() == docs.count()
    assert sorted(len(split(r.text)) for r in out.collect()) == sorted(n - gone for _, n, gone, _ in removed(rows))


def test_repeats_in_periodic_and_bounded_texts(spark):
    rng = random.Random(4)
    passage = words(rng, 35)
    rows = [(0, "a b " * 40), (1, "a " * 34), (2, passage), (3, passage + " tail"), (4, "head " + passage), (5, words(rng, 34)), (6, "b a " * 20), (7, "x " * 36), (8, " ".join(f"u{i}" for i in range(80)))]
    got = substring.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == removed(rows)


# --- 3: language model ------------------------------------------------------------------------------


def test_base_scores_match_brute_force(docs, empty):
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    tokens = {r.doc_id: [w.translate(ASCII_LOWER) for w in split(r.text)] + [None] for r in rows}
    c = Counter(t for r in rows if not held[r.doc_id] for t in tokens[r.doc_id])
    n, v = sum(c.values()), len(c)
    got = lm.scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[r.doc_id])
        assert abs(r.base_score - want) < 1e-6 and r.n_known == sum(c[t] > 0 for t in tokens[r.doc_id])
        assert (r.train_tokens, r.held_out, r.n_tokens) == (n, held[r.doc_id], len(tokens[r.doc_id]))
        assert r.score < 0 and r.bits_per_byte > 0
    assert lm.scores(empty).count() == 0


def model_of(texts):
    bits = lm.context_bits(sum(map(len, texts)))
    n = len(texts)
    table = pa.table({"text": texts, "train": [True] * n, "tune": [False] * n, "chunk": pa.array([0] * n, pa.int32())})
    parts = lm._counts(bits)(table).to_pylist()
    return lm.build([(p["part"], p["body"]) for p in parts if p["part"] is not None], bits)


def coded(texts):
    data, offsets = text_buffers(pa.array(texts))
    lower = lm.LOWER[data]
    return lm.stream(lower, offsets, word_spans(lower, offsets))


def bit_by_bit(model, text):
    """Nats of each byte of one coded text, by plain loops: contexts, codes, gates, weights that move after each block."""
    data = " ".join(split(text)).translate(ASCII_LOWER).encode() + b"\0"
    own, seen, costs, at = [0.0] * len(lm.ORDERS), [1e-2] * len(lm.ORDERS), [], 0
    while at < len(data):
        block = data[at : at + max(lm.BLOCK, at // lm.GROWTH)]
        grads = [0.0] * len(lm.ORDERS)
        for i in range(at, at + len(block)):
            rows, h, inside = [], 0, True
            for k in range(1, max(lm.ORDERS) + 1):
                before = data[i - k] if i >= k and inside else 0
                inside = inside and before != 0
                h = (h * 0x01000193 + before + k) % 2**32
                if k in lm.ORDERS:
                    b = model["bits"][lm.ORDERS.index(k)]
                    group = (data[i - 1] if i else 0) % lm.CLASSES
                    rows.append((group << b - lm.CLASS_BITS) + ((h * 0x9E3779B1 % 2**32) >> 32 - b + lm.CLASS_BITS))
            code, cost = group * 256 + data[i], 0.0
            for e in range(model["first"][code], model["first"][code] + model["lengths"][code]):
                node, bit = model["nodes"][e], model["taken"][e]
                x = [int(t[r * 256 + node]) for t, r in zip(model["tables"], rows)]
                gate = 0
                for o in x[1:]:
                    gate = gate * 4 + sum(abs(o) / lm.SCALE >= c for c in (1e-9, 2.7, 4.0))
                z = sum((model["weights"][k][gate] + own[k]) * o / lm.SCALE for k, o in enumerate(x))
                p = 1 / (1 + math.exp(-min(12, max(-12, z))))
                cost -= math.log(p if bit else 1 - p)
                for k, o in enumerate(x):
                    grads[k] += ((1 - p) if bit else -p) * o / lm.SCALE
            costs.append(cost)
        for k, g in enumerate(grads):
            seen[k] += g * g
            own[k] += lm.RATE * g / math.sqrt(seen[k])
        at += len(block)
    return costs


def test_byte_costs_match_a_coder_bit_by_bit():
    rng = random.Random(2)
    model = model_of([words(random.Random(i), 60, 50) for i in range(40)])
    model["weights"] = model["weights"] + np.random.default_rng(0).normal(0, 0.1, model["weights"].shape).astype(np.float32)
    texts = [words(rng, n, 60) for n in (1, 4, 30, 90)] + ["", "Été  \t w1x W2X", "one two"]
    data, begin = coded(texts)
    costs = lm.byte_costs(model, data, begin)
    for i, t in enumerate(texts):
        assert np.allclose(costs[begin[i] : begin[i + 1]], bit_by_bit(model, t), rtol=2e-3, atol=2e-3), t
        alone = lm.byte_costs(model, *coded([t]))
        assert np.allclose(alone, costs[begin[i] : begin[i + 1]], rtol=1e-4, atol=1e-5)


def test_word_costs_match_plain_loops():
    model = model_of([words(random.Random(1), 60, 50)])
    rng = np.random.default_rng(1)
    model["word_gates"] = np.array([0.5, 0.1, 0.3, 0.2])
    first = np.array([0, 0, 3, 60, 61])
    known = rng.choice([-np.inf, math.log(1e-5), math.log(1e-3)], 61, p=[0.3, 0.3, 0.4])
    spelled = rng.uniform(1, 30, 61)
    got = lm.word_costs(model, first, spelled, known, 1e-4)
    for a, b in zip(first[:-1], first[1:]):
        share, weight, i = [g * lm.WORD_WEIGHT for g in model["word_gates"]], [lm.WORD_WEIGHT] * 4, a
        while i < b:
            block, more = range(i, min(b, i + max(lm.WORD_BLOCK, (i - a) // 8))), []
            for j in block:
                g = 0 if j == a else 1 if known[j - 1] == -np.inf else 2 if known[j - 1] <= math.log(1e-4) else 3
                part = share[g] / weight[g]
                by_count, by_bytes = part * math.exp(known[j]), (1 - part) * math.exp(-spelled[j])
                assert got[j] == pytest.approx(-math.log(by_count + by_bytes), rel=1e-9)
                more.append((g, by_count / (by_count + by_bytes)))
            for g, r in more:
                share[g] += r
                weight[g] += 1
            i = block[-1] + 1


def test_model_codes_every_bit_once():
    """The codes are complete, likely texts cost less, and a model of nothing costs a bit for each bit."""
    model = model_of([words(random.Random(i), 60, 50) for i in range(40)])
    lengths = model["lengths"].reshape(lm.CLASSES, 256)
    assert np.allclose((2.0 ** -lengths.astype(float)).sum(1), 1)
    total = lambda m, t: lm.byte_costs(m, *coded([t])).sum()
    assert total(model, "w1x w2x w3x") < total(model, "qqq zzz vvv")
    empty = lm.build([])
    assert total(empty, "ab") / math.log(2) == pytest.approx(empty["lengths"].reshape(lm.CLASSES, 256)[[0, 97 % 32, 98 % 32], [97, 98, 0]].sum(), rel=1e-5)


def test_held_out_texts_score_above_the_base(spark):
    """Texts of a language of its own: the model must tell more than the shares of words do."""
    rng, rows = random.Random(6), []
    vocabulary = ["".join(rng.choice(["ta", "ri", "mo", "le", "sun", "ka"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    after = {w: rng.sample(vocabulary, 4) for w in vocabulary}
    for i in range(1500):
        text = [rng.choice(vocabulary)]
        for _ in range(rng.randrange(5, 120)):
            text.append(rng.choice(after[text[-1]]))
        rows.append((i, " ".join(text)))
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and len(held) > 100


def test_all_training_texts_are_counted_in_every_order(spark, monkeypatch):
    rows = [(i, words(random.Random(i), 12, 90)) for i in range(1500)]
    seen, build = [], lm.build
    monkeypatch.setattr(lm, "build", lambda parts, bits: seen.append(parts) or build(parts, bits))
    lm.scores(spark.createDataFrame(rows, "doc_id long, text string"))
    train = sum(len(t) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 10)  # with the end mark
    orders = Counter()
    for part, body in seen[0]:
        orders[part >> 16] += int(np.frombuffer(body, np.int64).sum()) if part < 0 else int(lm._unpacked(body)[1].sum())
    assert orders == {k: train for k in range(-1, len(lm.ORDERS))}


# --- 5: quality ----------------------------------------------------------------------------------


def test_quality_on_held_out_texts(spark, empty):
    rng, rows = random.Random(1), []
    for i in range(600):
        good = i % 3 > 0
        t = words(rng, 40, 300)
        rows.append((i, t if good else t.replace("x", "$$").upper(), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.where("doc_id < 400").drop("quality"), df.select("doc_id", "quality"))
    out = quality.score(df.where("doc_id >= 400"), model).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.quality) for r in out]) > 0.98
    again = quality.score(spark.createDataFrame([(1, None), (2, ""), (3, "y" * 50_000)], "doc_id long, text string"), model).collect()
    assert again[0].score == again[1].score and all(0 <= r.score <= 1 for r in again)
    none = quality.fit(df.drop("quality"), df.select("doc_id", "quality").limit(0))
    assert quality.score(df, none).first().score == pytest.approx(0.5)
    assert quality.classify(empty, df.select("doc_id", "quality"), df).count() == 0


def plain_features(text):
    """Slots of the byte n-grams and of the marks of repeated words, as sets."""
    data, found = (text or "").encode(), set()
    for k in range(1, 5):
        for i in range(len(data) - k + 1):
            gram = data[i]
            for c in data[i + 1 : i + k]:
                gram = (gram * 257 + c + 1) % 2**32
            found.add(((gram * 0x9E3779B1 + k * 0x05EBCA6B) % 2**32) >> (32 - quality.FEATURE_BITS))
    w = split(text)
    for k in range(1, 4):
        if any(len({*w[i : i + k + 1]}) == 1 for i in range(len(w) - k)):
            found.add(int(mix64(np.array([k + 7_000_000], np.uint64))[0]) >> (64 - quality.FEATURE_BITS))
    return sorted(found)


def test_quality_matches_plain_loops(spark):
    """Log-count ratios, the dual descent in the same order, the curve and the scores, by loops over sets and dicts."""
    rng, rows = random.Random(3), []
    for i in range(90):
        w = words(rng, rng.randrange(4, 25), 60)
        rows.append((i, w if i % 3 else f"{w} spam spam {'spam ' * rng.randrange(4)}", int(i % 3 > 0) if rng.random() < 0.9 else 0))
    rows += [(90, None, 0), (91, "", 1), (92, "é\U0001f600 é", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.drop("quality"), df.select("doc_id", "quality"))
    slots = {i: plain_features(t) for i, t, _ in rows}
    good = {i: q == 1 for i, _, q in rows}
    counts = Counter((good[i], s) for i in slots for s in slots[i])
    seen = {s for _, s in counts}
    total = {c: quality.SIZE + sum(n for (g, _), n in counts.items() if g == c) for c in (False, True)}
    ratio = {s: math.log((counts[True, s] + 1) / total[True]) - math.log((counts[False, s] + 1) / total[False]) if counts[True, s] + counts[False, s] >= 2 else 0.0 for s in seen}
    order = [r.doc_id for r in df.orderBy(F.xxhash64(F.lit(11), "doc_id")).collect()]
    norm = math.sqrt(sum(ratio[s] ** 2 for i in order for s in slots[i]) / len(order) + 1e-12)
    scale = {s: r / norm for s, r in ratio.items()}
    train, held = [i for n, i in enumerate(order) if n % 5 != 4], [i for n, i in enumerate(order) if n % 5 == 4]
    share = {c: len(train) / (2 * max(1, sum(good[i] == c for i in train))) for c in (False, True)}
    w, bias, alpha, shuffled = dict.fromkeys(seen, 0.0), 0.0, dict.fromkeys(train, 0.0), np.random.default_rng(5)
    for _ in range(quality.EPOCHS):
        for i in (train[n] for n in shuffled.permutation(len(train))):
            y = 1.0 if good[i] else -1.0
            slope = y * (sum(w[s] * scale[s] for s in slots[i]) + bias) - 1.0
            new = min(max(alpha[i] - slope / (sum(scale[s] ** 2 for s in slots[i]) + 1.0), 0.0), quality.COST * share[good[i]])
            step, alpha[i] = (new - alpha[i]) * y, new
            bias += step
            for s in slots[i]:
                w[s] += step * scale[s]
    margin = {i: sum(w[s] * scale[s] for s in slots[i]) + bias for i in slots}
    assert model["bias"] == pytest.approx(bias, abs=1e-6)
    n1, n0 = sum(good[i] for i in held), sum(not good[i] for i in held)
    off = [1 / (1 + math.exp(-(model["a"] * margin[i] + model["b"]))) - ((n1 + 1) / (n1 + 2) if good[i] else 1 / (n0 + 2)) for i in held]
    assert abs(sum(off)) < 1e-3 and abs(sum(o * margin[i] for o, i in zip(off, held))) < 2e-3  # where the curve's likelihood is greatest
    for r in quality.score(df, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model["a"] * margin[r.doc_id] + model["b"]))), abs=1e-4)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 20, 6) + (0 if i % 2 else 15)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, b = quality.dual_descent(rows, y, np.ones(40), np.ones(200), epochs=20)
    assert np.mean([np.sign(w[r].sum() + b) == t for r, t in zip(rows, y)]) > 0.97


# --- 4: benchmark leaks -----------------------------------------------------------------------------


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    s = sum((x & y).values())
    return s / (sum(x.values()) + sum(y.values()) - s)


def test_leaks_match_brute_force(spark, docs):
    rng = random.Random(3)
    items = [(i, words(rng, n, 3000)) for i, n in enumerate((40, 12, 5, 3, 25, 60))] + [(6, None), (7, ""), (8, None)]
    items.append((9, items[0][1]))
    edited = items[5][1].split()
    edited[1] = "changed"
    swapped = items[0][1].split()
    swapped[20] = "changed"
    rows = [(100, f"pre {items[0][1].upper()} post"), (101, items[1][1]), (102, "x, " + items[2][1] + "! y"), (103, f"q {items[3][1]} q"), (104, " ".join(edited)), (105, " ".join(swapped)), (106, items[4][1][:60]), (107, None), (108, f"{items[0][1]} {items[1][1]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item) for r in decontam.leaks(df, bench).collect()}
    want = set()
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for i, b in items[:6]:
            v = b.split()
            if any(similarity(w[s : s + len(v)], v) >= 0.8 for s in range(max(1, len(w) - len(v) + 1)) if len(w) >= 1):
                want.add((d, i))
    assert got == want and (104, 5) in got and (105, 0) not in got
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.leaks(df.limit(0), bench).count() == 0
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    named = df.withColumn("__leak", F.lit(1)).withColumn("decontam_leak", F.lit("clash")).withColumn("key", F.lit(2))
    kept = decontam.decontaminate(named, bench)
    assert kept.columns == named.columns and kept.where("decontam_leak = 'clash'").count() == len(rows) - len({d for d, _ in want})


def test_moved_passages_and_equal_items_match_brute_force(spark):
    rng = random.Random(11)
    items = [(i, words(rng, n, 3000)) for i, n in enumerate((100, 80, 40))] + [(3, "a b c d e " * 6)]
    items.append((7, items[0][1]))
    halves = items[0][1].split()
    moved = " ".join(halves[50:] + halves[:50])
    near = items[1][1].split()
    near = near[60:] + near[:60]
    near[0] = "changed"
    rows = [(1, f"{words(rng, 90, 3000)} {moved} {words(rng, 90, 3000)}"), (2, f"{words(rng, 9, 3000)} {' '.join(near)}"), (3, "a b c d e " * 5), (4, "a b c d e " * 90)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in rows:
        w = t.split()
        for i, b in items:
            v = b.split()
            s, at = max((similarity(w[x : x + len(v)], v), -x) for x in range(max(1, len(w) - len(v) + 1)))
            if s >= 0.8:
                want[d, i] = (s, -at)
    found = decontam.leaks(df, bench)
    got = {(r.id, r.item): (r.similarity, r.first_word) for r in decontam.every_item(found, bench).collect()}
    assert got == want and {(1, 0), (1, 7), (2, 1), (4, 3)} <= set(got)
    assert {r.doc_id for r in decontam.decontaminate(df, bench).collect()} == {1, 2, 3, 4} - {d for d, _ in want}


# --- 7: near duplicates ------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def alike(a, b):
    """Whether the longest common subsequence of the words reaches 0.8."""
    if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    most = sum((Counter(a) & Counter(b)).values())
    return most >= 0.8 * (len(a) + len(b) - most) and (c := lcs(a, b)) >= 0.8 * (len(a) + len(b) - c)


def classes_of(rows):
    sets = {i: split(t) for i, t in rows}
    root, texts = {i: i for i in sets}, dict(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                if alike(sets[a], sets[b]) or texts[a] == texts[b] or {texts[a], texts[b]} == {"", None}:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_classes_match_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = classes_of(rows)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    named = neardup.deduplicate(docs.withColumnsRenamed({"key": "__key", "size": "neardup_key"}))
    assert named.columns == ["doc_id", "text", "source", "__key", "neardup_key"] and named.where("__key = 'clash'").count() == len(set(want.values()))
    assert neardup.classes(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    rng, rows = random.Random(8), []
    base = words(rng, 200, 5000).split()
    rows.append((0, " ".join(base)))
    for i in range(1, 400):
        t = list(base)
        for k in rng.sample(range(200), 3):
            t[k] = f"e{i}k{k}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, words(rng, 150, 5000)) for i in range(50)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != 0 for i in range(400)) == 0 and all(got[i] == i for i in range(1000, 1050))


def test_pairs_behind_a_shared_passage_match_brute_force(spark):
    """Texts that are mostly one passage: all sketches of a pair lie in large buckets, whose leaders are like neither."""
    rng, rows = random.Random(5), []
    passage = words(rng, 75, 100_000)
    for i in range(0, 400, 2):
        twin = words(rng, 14, 100_000)
        own = [words(rng, 14, 100_000) for _ in range(2)]
        if i % 20:
            rows += [(i + k, f"{passage} {own[k]} {words(rng, 14, 100_000)}") for k in range(2)]
        else:
            rows += [(i + k, f"{passage} {twin} {own[k][:40]}") for k in range(2)]
    want = classes_of(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(i != c for i, c in want.items()) == 20


def test_recall_of_edited_copies(spark):
    """Of the pairs of which 2, 5 and 10 % of the words are replaced, at least 0.9 are joined, for texts of 20 to 300 words."""
    rng, rows, n = random.Random(9), [], 60
    kinds = [(size, share) for size in (20, 40, 79, 85, 150, 300) for share in (0.02, 0.05, 0.1)]
    for k, (size, share) in enumerate(kinds):
        for i in range(n):
            w = words(rng, size, 1_000_000).split()
            rows.append((10_000 * k + 2 * i, " ".join(w)))
            for j in rng.sample(range(size), max(1, int(share * size))):
                w[j] = f"edit{rng.random()}"
            rows.append((10_000 * k + 2 * i + 1, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [sum(got[10_000 * k + 2 * i + 1] == 10_000 * k + 2 * i for i in range(n)) / n for k in range(len(kinds))]
    assert min(found) >= 0.9 and sum(i != c for i, c in got.items()) == round(n * sum(found)), found


def test_alignment_is_the_longest_common_subsequence():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.alignment(a, a) == 1.0 and neardup.alignment(a, a[::-1].copy()) == 0.0
    assert abs(neardup.alignment(a, np.delete(a, [3, 50])) - 0.98) < 1e-12
    assert neardup.alignment(a, a[:0]) == 0.0
    rng = random.Random(3)
    for n in (1, 3, 7, 40, 200, 900):
        for trial in range(12):
            x = [rng.randrange(1 + trial * n) for _ in range(n)]
            y = list(x)
            for _ in range(rng.randrange(1 + n // 6)):
                k = rng.randrange(len(y)) if y else 0
                y[k : k + rng.randrange(2)] = [rng.randrange(1 + trial * n)] * rng.randrange(3)
            y = y or [0]
            c = lcs(x, y)
            want = c / (len(x) + len(y) - c)
            got = neardup.alignment(np.array(x, np.uint64), np.array(y, np.uint64))
            assert abs(got - want) < 1e-12 if want >= 0.8 else got < 0.8
            if want < 0.8:
                assert got == 0.0 or abs(got - want) < 1e-12


# --- 9: licences ---------------------------------------------------------------------------------------


def test_license_scan(spark, docs, empty):
    rows = [
        (0, "Released Under THE-mit   license. under the MIT license"), (1, "Apache License, Version 2.0"), (2, "cc by-nc 4.0 / CC BY NC"), (3, None), (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "all rights reserved?"), (7, "licence mit under the"), (8, "mit " * 5000 + "under the mit license"),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (10, "gnu public general license version 3"), (11, "under the Mıt license"),
    ]
    rows.append(rows[0])
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
        at = [(k, name) for p, name in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None), i
        assert r.base_labels == ",".join(sorted({n for _, n in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert by[5].labels == "gpl-3" and by[6].labels == "all-rights-reserved" and "mit" in by[9].labels.split(",") and by[10].labels == "" and 0 <= by[5].score <= 1
    assert license.scan(empty).count() == 0 and license.scan(docs).count() == docs.count()


def test_license_scan_of_all_templates_in_one_file(spark):
    texts = [t for _, _, t in license_texts.TEXTS]
    want = sorted({name for name, _, _ in license_texts.TEXTS})
    rows = [(0, "\n\n".join(texts)), (1, "nothing here")]
    rows += [(10 + i, f"a {t} b") for i, t in enumerate(texts)]
    rows += [(100 + i, "all rights reserved") for i in range(20)]
    rows += [(200 + i, f"/* {t.replace(',', ' *,').upper()} */ {t}") for i, t in enumerate(texts)]
    edited = []
    for i, t in enumerate(texts):  # words put in and left out, outside of the key phrases
        if len(t.split()) > 100 and (w := t.split()):
            edited.append(i)
            rows.append((300 + i, " ".join([*w[:40], "really", "so", *w[40:62], *w[64:]])))
    by = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[0].labels.split(",") == want and by[0].score == 1.0 and by[1].labels == ""
    for i, (name, _, _) in enumerate(license_texts.TEXTS):
        assert name in by[10 + i].labels.split(",") and by[10 + i].score == pytest.approx(1.0) and by[200 + i].labels == by[10 + i].labels
    assert all(license_texts.TEXTS[i][0] in by[300 + i].labels.split(",") for i in edited) and len(edited) > 5


def test_license_bodies_and_many_notices(spark):
    """Licences that stand as whole files, with their titles and copyright lines; and a file of many notices."""
    head = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    bodies = {
        "gpl-3": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {head} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast,",
        "lgpl": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {head} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional Definitions.",
        "mpl": "Mozilla Public License Version 2.0 ================================== 1. Definitions -------------- 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution. 1.3.",
    }
    bsd = next(t for name, _, t in license_texts.TEXTS if name == "bsd-2")
    rows = [(i, t) for i, t in enumerate(bodies.values())] + [(10, "\n\n".join(f"Copyright {1900 + i} {bsd}" for i in range(150))), (11, head)]
    by = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(bodies):
        assert name in by[i].labels.split(",")
    assert "bsd-2" in by[10].labels.split(",") and by[10].score == pytest.approx(1.0) and by[11].labels == ""


def test_license_labels_match_brute_force(spark):
    """Of texts that are cut and mixed at random."""
    rng, rows = random.Random(7), [(0, None), (1, ""), (2, "permission " * 300)]
    templates = license.TEMPLATES
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(templates)[0].split()
            low, high = sorted((rng.randrange(len(w) + 1) if rng.random() < 0.7 else 0, rng.randrange(len(w) + 1) if rng.random() < 0.7 else len(w)))
            parts += [words(rng, rng.randrange(6)), " ".join(w[low:high])]
        rows.append((10 + i, " ".join(parts)))
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    index = license.indexed_words()
    split_rows = {i: (t or "").split() for i, t in rows}
    df = Counter(w for t in split_rows.values() for w in set(t))
    idf = {w: math.log((len(rows) + 1) / (df[w] + 0.5)) for w, _, _ in index}
    for i, w in split_rows.items():
        found, best = set(), 0.0
        for t, (text, name, phrases) in enumerate(templates):
            votes = sorted((p - at, at) for p, x in enumerate(w) for y, of, at in index if of == t and x == y)
            need = 0.5 * sum(idf[x] for x, of, _ in index if of == t)
            keys = [(license._offset(text, m), [p for p in range(len(w)) if w[p : p + len(m.split())] == m.split()]) for m in phrases]
            low, total, runs = None, 0.0, set()
            for begins, at in votes:
                if low is None or begins - low > license.SLACK:
                    low, total = begins, 0.0
                total += idf[text.split()[at]]
                if total >= need - 1e-9:
                    runs.add(low)
            for low in runs:
                score = sum(idf[text.split()[at]] for at in {at for b, at in votes if low <= b <= low + license.SLACK}) / need / 2
                if score >= 0.5 - 1e-9 and all(any(abs(p - o - low) <= license.SLACK for p in at) for o, at in keys):
                    found.add(name)
                    best = max(best, min(1.0, score))
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == found | base and got[i].score == pytest.approx(1.0 if base else best), (i, w)
