"""Near duplicates by order MinHash.

A text's k-mers (SHINGLE words) are labelled by their occurrence, so that each is unique within the text. Each of
SKETCHES hash orders picks the two least of them; the pair, kept in the order of the text, is the sketch. Every edited
word breaks SHINGLE k-mers, so texts of fewer than SHORT words also get sketches of k-mers of SHORT_SHINGLE words. Texts
with a common sketch are candidates. Candidates are verified by a banded alignment of their words: the longest common
subsequence c of a and b words, within a band around the diagonal; c / (a + b - c) must reach THRESHOLD. The band is as
wide as two texts of that similarity can drift apart, so that it loses nothing.

Equal texts are one node from the start, named by the 128 bits of their MD5. First each bucket's nodes are held against
its leader, the node with the largest buckets, as the text is that the others were copied from. What this links is one
class. Then, in PASSES rounds, nodes of different classes are compared: in buckets of up to SMALL_BUCKET nodes all pairs
of them, in large ones a node of each class with LEADERS of those. No bucket is collected, and no two nodes with a
link between them that share a small bucket stay in different classes.

What is left, nodes of large buckets that still hold several classes, is joined exactly (``_exact_rest``), by prefixes of
their words, labelled by occurrence. A word that only one class holds cannot be common to two classes; the others, the
rarest first, are one order for all nodes. Of n words two similar nodes have ceil(THRESHOLD * n) in common at least, so that
those among a node's shared words but for the last ceil(THRESHOLD * n) - 1 hold one of them; only these are compared,
where place and length leave room for the similarity. Of the classes that hold such a word the largest is not held against
itself, so that a large class costs a row for each of its nodes and not for each pair of them.

Defined results: the class of a text is the least id among its class; null and empty texts are one node, linked to
nothing else; a text of fewer words than a k-mer is one k-mer; a null id counts as greater than any; rows alike
stay rows (``classes``) or become one (``deduplicate``); an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, free_name, in_slices, mix64, span_hashes, stored, text_buffers, text_key, word_spans

SHINGLE, THRESHOLD, SKETCHES = 5, 0.8, 20
SHORT, SHORT_SHINGLE = 80, 3
SMALL_BUCKET, LEADERS, PASSES = 16, 4, 2
#: Longs of a node's marks, a bit for each of its words by hash.
MARKS = 32
#: Rows of a round's table in one task.
ROUND_ROWS = 200_000
_ORDERS = mix64(np.arange(1, SKETCHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def labelled_shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words, each with its number among equal ones before it. words: a hash for each word."""
    if not len(words):
        return np.zeros(0, U64)
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return mix64(h)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    label = np.empty(len(s), U64)
    label[order] = (np.arange(len(s)) - begin).astype(U64)
    return mix64(h + label * U64(0xD6E8FEB86659FD93))


def sketches(shingles: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit sketch for each order: the two least shingles, in the order of the text."""
    orders = _ORDERS ^ U64(salt)
    if not len(shingles):
        return shingles
    if len(shingles) == 1:
        return mix64(shingles ^ orders)
    pairs = np.empty((SKETCHES, 2), np.int64)
    step = max(1, (1 << 17) // len(shingles))
    for j in range(0, SKETCHES, step):
        x = (shingles ^ orders[j : j + step, None]) * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        pairs[j : j + step] = np.argpartition(x, 1, axis=1)[:, :2]
    pairs.sort(axis=1)
    return mix64(shingles[pairs[:, 0]] * U64(0xA0761D6478BD642F) + mix64(shingles[pairs[:, 1]] ^ orders))


def text_sketches(words: np.ndarray) -> np.ndarray:
    """All sketches of a text of these word hashes."""
    found = sketches(labelled_shingles(words))
    if len(words) < SHORT:
        found = np.concatenate([found, sketches(labelled_shingles(words, SHORT_SHINGLE), SHORT_SHINGLE)])
    return found


def _common(a: list[int], b: list[int], low: int, high: int) -> int:
    """Length of the longest common subsequence, of places i and j with low <= j - i <= high at least.

    A column is a bit that is clear once it ends a longer subsequence; rows are taken in blocks, and the bits are those
    of the columns that a block's rows can reach."""
    step = max(64, high - low)
    left, ones, state, found = 0, 0, 0, 0  # state: bits of the columns left .. left + ones - 1
    for first in range(0, len(a), step):
        rows = a[first : first + step]
        begin, end = min(max(0, first + low), len(b)), min(len(b), first + len(rows) + high)
        gone = min(begin - left, ones)
        found += gone - (state & ((1 << gone) - 1)).bit_count()
        state >>= gone
        left, ones = begin, max(ones - gone, 0)
        if end - left > ones:
            state |= ((1 << (end - left - ones)) - 1) << ones
            ones = end - left
        columns: dict[int, int] = {}
        bit = 1
        for x in b[left : left + ones]:
            columns[x] = columns.get(x, 0) | bit
            bit <<= 1
        whole = bit - 1
        for x in rows:
            hit = columns.get(x)
            if hit:
                u = state & hit
                state = ((state + u) | (state - u)) & whole
    return found + ones - state.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two word sequences by their longest common subsequence within the band; 0 if it can't reach threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    need = threshold / (1 + threshold) * (n + m) - 1e-9
    short = min(n, m)
    other = np.flatnonzero(a[:short] != b[:short])
    head = int(other[0]) if len(other) else short
    other = np.flatnonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])
    tail = int(other[0]) if len(other) else short - head
    x, y = a[head : n - tail], b[head : m - tail]
    c = head + tail
    if len(x) and len(y):
        words, number = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = number[: len(x)], number[len(x) :]
        if c + np.minimum(np.bincount(x, minlength=len(words)), np.bincount(y, minlength=len(words))).sum() < need:
            return 0.0
        c += _common(x.tolist(), y.tolist(), -int(n - need) - 1, int(m - need) + 1)
    return c / (n + m - c) if c >= need else 0.0


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 2 << 20):
        data, offsets = text_buffers(batch.column("text"))
        starts, ends, first = word_spans(data, offsets)
        h = span_hashes(data, starts, ends)
        found = [text_sketches(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(found), pa.array(np.diff(first).astype(np.int32))], ["key", "sketches", "n"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        memo: dict = {}

        def words(key, text):
            if key not in memo:
                if len(memo) > 256:
                    memo.clear()
                data, offsets = text_buffers(pa.array([text], pa.string()))
                starts, ends, _ = word_spans(data, offsets)
                memo[key] = span_hashes(data, starts, ends)
            return memo[key]

        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("text_a"), batch.column("text_b")
        sim = [alignment(words(a[i], left[i].as_py()), words(b[i], right[i].as_py())) for i in range(len(a))]
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], ["a", "b", "similarity"])
        yield out.filter(pa.array([s > 0 for s in sim]))


def _similar_length() -> Column:
    """Whether two nodes have numbers of words that allow the wanted similarity at all."""
    return F.least("na", "nb") >= F.lit(THRESHOLD) * F.greatest("na", "nb")


def _stars(members: DataFrame, leaders: int = 1) -> DataFrame:
    """Pairs (a, b) of the nodes of each bucket and its leaders: one leader, or in large buckets one of each hash class."""
    part = F.when(F.col("g") > SMALL_BUCKET, F.pmod(F.xxhash64("key"), F.lit(leaders))).otherwise(0)
    heads = members.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("s", F.xxhash64("key").alias("o"), "key", "n")).alias("l"))
    heads = heads.select("bucket", F.col("l.key").alias("leader"), F.col("l.n").alias("nb"))
    led = members.select("bucket", "key", F.col("n").alias("na")).join(heads, "bucket").where("key != leader").where(_similar_length())
    return led.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()


def _rest(members: DataFrame, within: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different classes: all of them in small buckets; in large ones a node of each class, in stars."""
    rooted = members.join(within, members["key"] == within["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    rooted = stored(rooted.join(mixed, "bucket", "left_semi"), "neardup-mixed")
    small = rooted.where(F.col("g") <= SMALL_BUCKET).select("bucket", F.col("key").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    other = small.select("bucket", F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("na").alias("nb"))
    pairs = small.join(other, "bucket").where("a < b AND ra != rb").where(_similar_length()).select("a", "b")
    best = F.max(F.struct("s", F.xxhash64("bucket", "key").alias("o"), "key", "n"))
    heads = rooted.where(F.col("g") > SMALL_BUCKET).groupBy("bucket", "root", "g").agg(best.alias("h")).select("bucket", "g", "h.key", "h.s", "h.n")
    return pairs.unionByName(_stars(heads, LEADERS)).distinct()


def _labelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 2 << 20):
        data, offsets = text_buffers(batch.column("text"))
        starts, ends, first = word_spans(data, offsets)
        h = span_hashes(data, starts, ends)
        found = [labelled_shingles(h[a:b], 1) for a, b in zip(first[:-1], first[1:])]
        marks = [_marks(x) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("root"), _lists([x.view(np.int64) for x in found]), _lists(marks)], ["key", "root", "words", "marks"])


def _marks(words: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[mix64(words) % U64(64 * MARKS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lacks(a: str, b: str) -> Column:
    """Number of marks of a that b lacks: as many words of a at least are not in b."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, n: s + n)


def _exact_rest(members: DataFrame, within: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes that hold every pair of THRESHOLD or more among the nodes of large buckets."""
    rooted = members.where(F.col("g") > SMALL_BUCKET).join(within, members["key"] == within["node"], "left").withColumn("root", F.coalesce("root", "key"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    nodes = rooted.join(mixed, "bucket", "left_semi").select(F.col("key").alias("node"), "root").distinct()
    held = texts.join(nodes, texts["key"] == nodes["node"]).select("key", "root", "text")
    held = stored(held.mapInArrow(_labelled_words, "key binary, root binary, words array<long>, marks array<long>"), "neardup-words")

    # words that several classes hold, the rarest first: what two classes have in common is among these
    each = held.select("key", "root", F.size("words").alias("n"), F.explode("words").alias("v"))
    across = each.groupBy("v").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("v", "c")
    ranked = each.join(across, "v").groupBy("key", "root", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("live"))
    ranked = ranked.join(held.select("key", "marks"), "key")
    wanted = F.ceil(F.lit(THRESHOLD) * F.col("n") - 1e-9).cast("int")
    ranked = ranked.withColumn("prefix", F.size("live") - wanted + 1).where("prefix > 0")
    spread = ranked.select("key", "root", "n", "marks", F.transform("live", lambda e: e.v).alias("live"), F.posexplode(F.slice("live", 1, F.col("prefix"))).alias("at", "e"))
    ahead = F.slice("live", F.greatest(F.col("at") - 15, F.lit(1)), F.least("at", F.lit(16)))
    spread = stored(spread.select("key", "root", "n", "marks", (F.size("live") - F.col("at")).alias("left"), F.col("e.v").alias("v"), ahead.alias("ahead")), "neardup-prefixes")

    # of each word's classes the largest is not compared with itself
    sizes = spread.groupBy("v", "root").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("v").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("v", F.col("top.root").alias("top"))
    spread = stored(spread.join(sizes, "v"), "neardup-shared")

    # at its first common word a pair has that one and what follows in both: enough for the similarity, or no pair;
    # at a later one it is left out where the words just ahead (16 at most) show that there was an earlier one
    a = spread.where("root != top").select("v", F.col("key").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("ahead").alias("ha"), F.col("marks").alias("ma"))
    b = spread.select("v", F.col("key").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("ahead").alias("hb"), F.col("marks").alias("mb"))
    room = F.least("la", "lb") >= F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = a.join(b, "v").where("ra != rb").where(_similar_length()).where(room).where(~F.arrays_overlap("ha", "hb"))
    need = F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = pairs.where((F.col("na") - _lacks("ma", "mb") >= need) & (F.col("nb") - _lacks("mb", "ma") >= need))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the least node of its component: alternating large and small stars.

    Each round is two groupings with partial aggregation and two joins; it ends when the stars stay as they are. The
    tables of a round have as many partitions as their rows need, so that a few edges do not cost hundreds of tasks."""
    edges = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v"), "components")
    tasks, before = None, None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before, tasks = now, max(4, now["n"] // ROUND_ROWS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u != v").coalesce(tasks).distinct().coalesce(tasks), "components")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root")).coalesce(tasks or 4)


def links(texts: DataFrame) -> DataFrame:
    """texts: (key, text), a row or more for each key. Verified links (a, b, similarity) between keys that join all classes."""
    sketched = texts.mapInArrow(_sketched, "key binary, sketches array<long>, n int").dropDuplicates(["key"])
    members = sketched.select("key", "n", F.posexplode("sketches").alias("j", "v")).select(F.xxhash64("j", "v").alias("bucket"), "key", "n")
    members = stored(members, "neardup-sketches")
    counts = members.groupBy("bucket").agg(F.count("*").alias("g")).where("g > 1")
    shared = stored(members.join(counts, "bucket"), "neardup-buckets")
    popular = shared.groupBy(F.col("key").alias("node")).agg(F.sum("g").alias("s"))
    shared = stored(shared.join(popular, shared["key"] == popular["node"]).select("bucket", "key", "n", "g", "s"), "neardup-members")

    # the texts of all nodes that share a bucket; the same join at every size
    nodes = shared.select(F.col("key").alias("node")).distinct().hint("merge")
    held = stored(texts.join(nodes, texts["key"] == nodes["node"], "left_semi").dropDuplicates(["key"]), "neardup-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(held.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a binary, b binary, similarity double"), "neardup-links")

    tried = stored(_stars(shared), "neardup-stars")
    found = verified(tried)
    for _ in range(PASSES):
        roots = stored(components(found.select("a", "b")), "neardup-roots")
        pairs = stored(_rest(shared, roots).join(tried, ["a", "b"], "left_anti"), "neardup-rest")
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        found = found.unionByName(verified(pairs))
    roots = stored(components(found.select("a", "b")), "neardup-roots")
    pairs = stored(_exact_rest(shared, roots, held).join(tried, ["a", "b"], "left_anti"), "neardup-exact")
    return found.unionByName(verified(pairs))


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, class_id, class_key, class_size, n_links) of every row; class_id and class_key name the row to keep."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(links(rows.select("key", "text")), "neardup-all-links")
    roots = components(found.select("a", "b"))
    ends = found.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count("*").alias("n_links"))
    marks = stored(roots.join(ends, roots["node"] == ends["of"], "left").select("node", "root", "n_links"), "neardup-marks")
    placed = rows.select("id", "key").join(marks, F.col("key") == marks["node"], "left")
    placed = placed.select("id", "key", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    placed = stored(placed, "neardup-placed")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key"))
    heads = placed.groupBy(F.col("root").alias("of")).agg(first.alias("head"), F.count("*").alias("class_size"))
    out = placed.join(heads, placed["root"] == heads["of"])
    return out.select("id", "key", F.col("head.id").alias("class_id"), F.col("head.key").alias("class_key"), "class_size", "n_links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size, n_links) of every row: the least id of its class, the rows of the class, and how many of the
    links that were verified to join the classes end at its text."""
    return _classed(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the one with the least id; all columns are kept."""
    key, kept_id, kept_key = (free_name(docs, c) for c in ("neardup_key", "neardup_kept_id", "neardup_kept_key"))
    kept = _classed(docs, id_col, text_col).select(F.col("class_id").alias(kept_id), F.col("class_key").alias(kept_key)).distinct()
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    kept = keyed.join(kept, (F.col(key) == F.col(kept_key)) & keyed[id_col].eqNullSafe(F.col(kept_id)), "left_semi")
    return kept.dropDuplicates([id_col, key]).drop(key)
