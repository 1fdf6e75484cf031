"""Benchmark decontamination by fingerprints of item-sized windows.

A window of a document is as long as the benchmark item it is held against. What the two have in common is at most the
number of the window's shingles, of SHINGLE words, that stand anywhere in the item; so every start with as many of them
in reach as THRESHOLD asks for is a window worth a fingerprint, wherever in the item they stand, and no other window can
reach it. The windows and the items get SimHash fingerprints; both are indexed by RADIUS + 1 blocks of bits, of which
two fingerprints within RADIUS share one at least (pigeonhole). What the index finds is verified by the exact
similarity of the two multisets of shingles, weighted by their counts: sum of minima over sum of maxima, THRESHOLD or more.

The radius leaves room: at a similarity of 0.8 two 64-bit fingerprints differ in 10 bits on average, with a
standard deviation of 3; the exact check decides anyway.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case. Defined results: null or empty
texts and items match nothing; an item of fewer than SHINGLE words is one shingle; a document with several like
windows has a row for the best one of each item (the first on ties); rows alike in id and text count once; empty
tables give empty results; further columns play no part and are kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, text_key
from .license import NOT_WORD

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 24
#: Pairs of an item and its shingle that are broadcast at most (20 bytes each and overhead); beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(hashes: str, k: int) -> Column:
    """Hashes of all runs of k words."""
    n = F.size(hashes)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint: each bit has the majority's value among the hashes."""
    half = F.size(shingles) / 2

    def bit(b):
        ones = F.aggregate(shingles, F.lit(0), lambda s, h: s + F.getbit(h, b))
        return F.when(ones > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """Array of (block, value) of the radius + 1 blocks that the 64 bits are dealt into."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    return F.array(*parts)


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each distinct item text: item (its least id), words n, shingle length k, shingles, fingerprint, ids."""
    w = benchmark.select(F.col(item_col).alias("id"), F.transform(_words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("hashes")).where(F.size("hashes") > 0)
    w = w.groupBy("hashes").agg(F.min("id").alias("item"))
    w = w.withColumn("n", F.size("hashes")).withColumn("k", F.least(F.lit(SHINGLE), F.col("n")))
    chosen = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        chosen = F.when(F.col("k") == k, _shingles("hashes", k)).otherwise(chosen)
    return w.withColumn("shingles", chosen).withColumn("fingerprint", simhash(F.col("shingles"))).drop("hashes")


def _starts(places: Column, need: Column, m: Column, last: Column) -> Column:
    """All starts up to last of m shingles with at least need of the (sorted) places among them."""

    def run(i):
        low = F.greatest(F.lit(0), F.get(places, i + need - 1) - m + 1, F.get(places, i - 1) + 1)
        high = F.least(F.get(places, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - need), run))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, key, item, similarity, first_word, n_words): the best window of each document for each item that it holds.

    key names the document's text (``common.text_key``); items with one text are represented by the least of their ids."""
    items = stored(items_of(benchmark, item_col, item_text), "decontam-items")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())
    if not lengths:
        lengths = [SHINGLE]
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("hashes", F.transform(_words(F.col("text")), lambda x: F.xxhash64(x))).drop("text")

    # starts of the windows with enough shingles of an item
    postings = items.select("item", "n", "k", F.explode(F.array_distinct("shingles")).alias("shingle"))
    small = (items.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_ROWS
    starts = None
    for k in lengths:
        place = hashed.select("id", "key", F.size("hashes").alias("words"), F.posexplode(_shingles("hashes", k)).alias("p", "shingle"))
        own = postings.where(F.col("k") == k).drop("k")
        hit = place.join(F.broadcast(own) if small else own, "shingle")
        hit = hit.groupBy("id", "key", "words", "item", "n").agg(F.array_sort(F.collect_set("p")).alias("ps"))
        hit = hit.withColumn("m", F.least("n", "words") - k + 1)
        hit = hit.withColumn("need", F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("m") + F.col("n") - k + 1) - 1e-9).cast("int")))
        hit = hit.where(F.size("ps") >= F.col("need")).withColumn("starts", _starts(F.col("ps"), F.col("need"), F.col("m"), F.greatest(F.lit(0), F.col("words") - F.col("n"))))
        hit = hit.where(F.size("starts") > 0).select("id", "key", F.lit(k).alias("k"), "item", "n", "starts")
        starts = hit if starts is None else starts.unionByName(hit)
    starts = stored(starts, "decontam-windows")

    # fingerprints of those windows
    held = starts.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    kept = rows.join(held, (rows["key"] == held["__key"]) & rows["id"].eqNullSafe(held["__id"]), "left_semi").dropDuplicates(["id", "key"])
    kept = kept.withColumn("hashes", F.transform(_words(F.col("text")), lambda x: F.xxhash64(x))).drop("text")
    wanted = starts.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "k", "item", "n", "starts")
    windows = kept.join(wanted, (kept["key"] == wanted["__key"]) & kept["id"].eqNullSafe(wanted["__id"]))
    cut = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("hashes", s + 1, F.col("n")).alias("hashes")))
    windows = windows.select("id", "key", "k", "item", "n", F.explode(cut).alias("w")).select("id", "key", "k", "item", "n", "w.*")
    chosen = F.array().cast("array<bigint>")
    for k in lengths:
        chosen = F.when(F.col("k") == k, _shingles("hashes", k)).otherwise(chosen)
    windows = stored(windows.select("id", "key", "item", "n", "start", chosen.alias("shingles")).where(F.size("shingles") > 0), "decontam-shingles")
    windows = stored(windows.withColumn("fingerprint", simhash(F.col("shingles"))), "decontam-fingerprints")

    # multi-index: pairs of a window and an item within the radius share a block
    by_window = windows.select("id", "key", "item", "start", F.col("fingerprint").alias("fw"), F.explode(_blocks(F.col("fingerprint"), radius)).alias("b")).select("*", "b.*").drop("b")
    by_item = items.select("item", F.col("fingerprint").alias("fi"), F.explode(_blocks(F.col("fingerprint"), radius)).alias("b")).select("*", "b.*").drop("b")
    near = by_window.join(by_item, ["item", "block", "value"]).where(F.bit_count(F.col("fw").bitwiseXOR(F.col("fi"))) <= radius)
    near = near.select("id", "key", "item", "start").distinct()

    # exact similarity of the multisets
    on = (windows["key"] == near["key"]) & windows["id"].eqNullSafe(near["id"]) & (windows["item"] == near["item"]) & (windows["start"] == near["start"])
    candidates = windows.join(near, on, "left_semi")
    repeated = items.select("item", F.explode("shingles").alias("v")).groupBy("item", "v").agg(F.count("*").alias("c")).where("c > 1")
    repeated = repeated.groupBy("item").agg(F.collect_list(F.struct("v", "c")).alias("repeated"))
    of_item = items.select("item", F.col("shingles").alias("of_item")).join(repeated, "item", "left")
    both = candidates.join(of_item, "item")
    more = F.aggregate(F.coalesce("repeated", F.array().cast("array<struct<v:bigint,c:bigint>>")), F.lit(0).cast("long"), lambda s, r: s + F.greatest(F.lit(0), F.least(F.size(F.filter("shingles", lambda x: x == r.v)), r.c) - 1))
    shared = both.withColumn("s", F.size(F.array_intersect("shingles", "of_item")) + more)
    scored = shared.withColumn("similarity", F.col("s") / (F.size("shingles") + F.size("of_item") - F.col("s"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("id", "key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("b"))
    return best.select("id", "key", "item", "b.similarity", (-F.col("b.back")).alias("first_word"), F.col("b.n").alias("n_words"))


def every_item(found: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """found (``leaks``) with a row for each id of the items of one text instead of the least of them."""
    named = benchmark.select(F.col(item_col).alias("named"), F.transform(_words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("hashes")).where(F.size("hashes") > 0).distinct()
    least = named.groupBy("hashes").agg(F.min("named").alias("item"))
    same = named.join(least, "hashes").select("item", "named")
    return found.join(same, "item").withColumn("item", F.col("named")).drop("named")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a window like a benchmark item; all columns are kept."""
    leak = free_name(docs, "decontam_leak")
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("key").alias(leak)).distinct()
    return docs.join(bad, text_key(F.col(text_col)) == F.col(leak), "left_anti")
