import bisect
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing, sharding
from tidewell.llm.common import uniform

from .conftest import words


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight with caps, the excess reshared round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix_reaches_targets(docs):
    rows = mixing.plan(docs).collect()
    assert sum(r.n for r in rows) == docs.count()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs.collect():
        sizes[d.source] += count(d.text)
    for r in rows:
        taken[r.source] += r.unit_size * r.copies
        most[r.source] = max(most[r.source], r.unit_size)
        assert r.copies <= 3 and r.source_size == sizes[r.source]
    want = targets(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()), key=str)


def test_mix_keeps_columns_and_repeats(docs, empty):
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0
    flat = docs.select("doc_id", F.lit("").alias("text"), "source")
    assert mixing.mix(flat).count() == 0


def test_mix_is_unbiased_and_spreads_hot_sources(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.expr("repeat('w ', 1 + cast(id % 37 as int))").alias("text"))
    by = {r.source: r for r in mixing.plan(rows).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    for r in by.values():
        assert abs(r.taken - r.target) <= 20


def test_every_document_keeps_its_expected_copies(spark):
    """Mean copies over many sources of the same sizes: each near its chance, and each source near its target."""
    sizes, sources, share = [1500, 900, 700, 400, 250, 100, 60, 45, 30, 20, 12, 7], 300, 0.37
    rows = [(f"{s}-{i}", s * 100 + i, f"s{s}", a, 1) for s in range(sources) for i, a in enumerate(sizes)]
    units = spark.createDataFrame(rows, "doc string, key long, source string, unit_size long, n long")
    total = sum(sizes)
    targets = spark.createDataFrame([(f"s{s}", total, share * total, len(sizes)) for s in range(sources)], "source string, source_size long, target double, units long")
    got = mixing.copies(units, targets).collect()
    mean, taken = defaultdict(float), defaultdict(int)
    for r in got:
        mean[r.unit_size] += r.copies / sources
        taken[r.source] += r.unit_size * r.copies
    assert len(got) == len(rows) and all(abs(m - share) < 0.12 for m in mean.values()), mean
    assert abs(sum(taken.values()) / sources - share * total) < 20
    off = sorted(abs(t - share * total) for t in taken.values())
    assert off[len(off) // 2] <= 100  # small ones, but where the chances of the smaller documents leave no more room


def check_shards(out, n, shards):
    slots, size = defaultdict(set), defaultdict(int)
    for r in out:
        assert r.slot not in slots[r.shard]
        slots[r.shard].add(r.slot)
    assert len(out) == n and all(s == set(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_are_gapless_and_groups_stay(docs, empty):
    out = sharding.shard(docs, 4).collect()
    check_shards(out, docs.count(), 4)
    where = defaultdict(set)
    for r in out:
        where[r.text or ""].add(r.shard)
    assert all(len(w) == 1 for w in where.values())
    assert sharding.shard(docs, 4).columns == [*docs.columns, "slot", "shard"]
    named = sharding.shard(docs.withColumnsRenamed({"key": "slot", "size": "shard"}), 4)
    assert named.columns == ["doc_id", "text", "source", "docs_slot", "docs_shard", "slot", "shard"] and named.where("docs_slot = 'clash'").count() == docs.count()
    both = sharding.shard(docs.withColumnsRenamed({"key": "slot", "size": "docs_slot"}), 4)
    assert both.columns == ["doc_id", "text", "source", "docs_docs_slot", "docs_slot", "slot", "shard"] and both.where("docs_docs_slot = 'clash'").count() == docs.count()
    assert sharding.shard(empty, 4).count() == 0


def test_shards_are_even_with_hot_keys(spark):
    text = F.when(F.col("id") % 3 == 0, "one text that a third of all rows share").when(F.col("id") % 50 == 1, "another copy").otherwise(F.concat(F.lit("text "), F.col("id"), F.expr("repeat('x', cast(id % 90 as int))")))
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    out = sharding.shard_index(rows, 24).collect()
    check_shards(out, 12_000, 24)
    load = defaultdict(int)
    for r in out:
        load[r.shard] += r["size"]
    assert len(load) == 24 and max(load.values()) < 1.05 * min(load.values())
    small = defaultdict(set)
    for r in out:
        if r.doc_id % 50 == 1 and r.doc_id % 3:
            small[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in small.values())


def plain_shards(rows, shards):
    """The shard and slot of each (key, id, size, u, h): splitters, heavy keys, placing and filling as loops. u: the row's place in the
    sample, h: the hash that splits keys."""
    total = sum(r[2] for r in rows)
    per = min(sharding.MAX_RANGES_PER_SHARD, max(sharding.RANGES_PER_SHARD, total // (shards * sharding.RANGE_BYTES)))
    ranges, share, quota = shards * per, max(1.0, total / (shards * per)), max(1.0, total / shards)
    sample = sorted(k for k, _, size, u, _ in rows if u < size * (sharding.SAMPLES_PER_RANGE / share))
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    placed = {k: bisect.bisect_right(bounds, k) for k, *_ in rows}
    in_range, of_key = Counter(), Counter()
    for k, _, size, _, _ in rows:
        in_range[placed[k]] += size
        of_key[k] += size
    heavy = {k for k in of_key if in_range[placed[k]] > 1.5 * share and of_key[k] > share}
    units = defaultdict(list)
    for i, (k, ident, size, _, h) in enumerate(rows):
        units[placed[k], k if k in heavy else None, h % math.ceil(of_key[k] / share) if k in heavy else 0].append(i)
    low = lambda v: (v is not None, v or 0)  # noqa: E731  nulls first
    pieces = Counter()
    piece_of = {u: (u[0], u[1], u[2] if u[1] is not None and of_key[u[1]] > quota else None) for u in units}
    for u, members in units.items():
        pieces[piece_of[u]] += sum(rows[i][2] for i in members)
    home, loads = {}, [0] * shards
    for p, size in sorted(pieces.items(), key=lambda x: (x[1], x[0][0], low(x[0][1]), low(x[0][2])), reverse=True):
        if size > quota / 32:
            home[p] = loads.index(min(loads))
            loads[home[p]] += size
    room = [max(0.0, quota - x) for x in loads]
    upto = list(itertools.accumulate(x / (sum(room) or 1.0) for x in room))
    small = sorted((p for p in pieces if p not in home), key=lambda p: (p[0], low(p[1]), low(p[2])))
    whole, done = sum(pieces[p] for p in small), 0
    for p in small:
        home[p] = min(shards - 1, sum(x <= (done + pieces[p] / 2) / whole for x in upto))
        done += pieces[p]
    out, filled = {}, Counter()
    for u in sorted(units, key=lambda u: (u[0], low(u[1]), u[2])):
        for i in sorted(units[u], key=lambda i: (rows[i][0], rows[i][1] or "")):
            shard = home[piece_of[u]]
            out[i] = shard, filled[shard]
            filled[shard] += 1
    return out


@pytest.mark.parametrize("shards", [3, 24])
def test_shards_match_plain_loops(spark, shards):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(700)] + ["one text that many share " * 3] * 400 + [words(rng, 3000)] * 3 + [words(rng, 60_000), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    key, ident = F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")
    known = df.select("doc_id", key.alias("k"), ident.alias("i"), sharding.record_size(F.col("text")).alias("s"), uniform(F.lit(29), key, ident).alias("u"), F.xxhash64(F.lit(23), ident).alias("h")).orderBy("doc_id").collect()
    want = plain_shards([(r.k, r.i, r.s, r.u, r.h) for r in known], shards)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_index(df, shards).collect()}
    assert got == {r.doc_id: want[n] for n, r in enumerate(known)} and len({s for s, _ in got.values()}) == shards
