"""Sharding by sampled splitters.

Keys are hashes of the texts, so that equal texts share one. Splitters are the size-weighted quantiles
of a sample of keys; they cut all records into many small ranges. Ranges that turn out overfull are
subdivided: a key that alone exceeds a range's share becomes a piece of its own, and one that exceeds
a whole shard's share is cut further by record. Large pieces go to shards one by one, the largest first;
the rest fill the shards in the order of their keys. Only tables with a bounded number of rows (ranges,
heavy keys, pieces) are broadcast; the bound is shards * MAX_RANGES_PER_SHARD times a small constant.

Defined results: a null text is an empty one (size 8, crc 0); rows alike get different slots of one
shard; a null id counts as one of its own; an empty table gives an empty result; further columns are kept by ``shard``;
those named slot or shard get the prefix docs_, once more while that name is taken; names that start with ``__shard_`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, uniform

RANGES_PER_SHARD, MAX_RANGES_PER_SHARD, RANGE_BYTES = 64, 4096, 64 << 20
SAMPLES_PER_RANGE = 20
#: Cells of the key space by its leading bits, for looking ranges up by an equi-join.
CELL_BITS = 12


def record_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, and 8 for the record itself."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _cell(key: Column) -> Column:
    return F.shiftright(key, 64 - CELL_BITS)


def _placed(rows: DataFrame, cells: DataFrame, heavy: DataFrame) -> DataFrame:
    """Adds the unit (__shard_range, __shard_heavy, __shard_sub) of each row that has __shard_key and __shard_id."""
    rows = rows.withColumn("__shard_cell", _cell(F.col("__shard_key"))).join(F.broadcast(cells), "__shard_cell")
    r = F.col("__shard_base") + F.size(F.filter("__shard_bounds", lambda b: b <= F.col("__shard_key")))
    rows = rows.withColumn("__shard_range", r.cast("long")).drop("__shard_cell", "__shard_base", "__shard_bounds")
    if heavy is None:
        return rows
    rows = rows.join(F.broadcast(heavy), F.col("__shard_key") == F.col("__shard_heavy"), "left")
    sub = F.pmod(F.xxhash64(F.lit(23), "__shard_id"), F.coalesce("__shard_parts", F.lit(1)))
    return rows.withColumn("__shard_sub", F.when(F.col("__shard_heavy").isNotNull(), sub).otherwise(0)).drop("__shard_parts", "__shard_split")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> DataFrame:
    """docs with shard int (0 to shards - 1) and slot long (gapless from 0 within a shard)."""
    for c in ("slot", "shard"):
        docs = docs.withColumnRenamed(c, free_name(docs, c, "docs_"))
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    slim = docs.select(F.xxhash64(text).alias("__shard_key"), ident.cast("string").alias("__shard_id"), record_size(F.col(text_col)).alias("__shard_size"))
    full = docs.withColumn("__shard_key", F.xxhash64(text)).withColumn("__shard_id", ident.cast("string"))
    return _assigned(stored(slim, "shard-keys"), full, shards, seed).drop("__shard_key", "__shard_id")


def _assigned(slim: DataFrame, full: DataFrame, shards: int, seed: int) -> DataFrame:
    spark = slim.sparkSession
    total = slim.agg(F.sum("__shard_size")).first()[0] or 0
    per = min(MAX_RANGES_PER_SHARD, max(RANGES_PER_SHARD, total // (shards * RANGE_BYTES)))
    ranges, share, quota = shards * per, max(1.0, total / (shards * per)), max(1.0, total / shards)

    # splitters: size-weighted sample, quantiles; the sample has about ranges * SAMPLES_PER_RANGE keys
    chance = F.col("__shard_size") * (SAMPLES_PER_RANGE / share)
    sample = slim.where(uniform(F.lit(seed), "__shard_key", "__shard_id") < chance).agg(F.sort_array(F.collect_list("__shard_key")).alias("s"))
    quantile = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / F.lit(ranges)).cast("int")))
    bounds = sample.select(F.explode(F.array_sort(F.array_distinct(quantile))).alias("b")).where("b is not null")
    by_cell = bounds.groupBy(_cell(F.col("b")).alias("__shard_cell")).agg(F.collect_list("b").alias("__shard_bounds"))
    half = 1 << (CELL_BITS - 1)
    cells = spark.range(-half, half).select(F.col("id").alias("__shard_cell")).join(F.broadcast(by_cell), "__shard_cell", "left")
    cells = cells.withColumn("__shard_bounds", F.coalesce("__shard_bounds", F.array().cast("array<bigint>")))
    before = Window.orderBy("__shard_cell").rowsBetween(Window.unboundedPreceding, -1)  # 2**CELL_BITS rows
    cells = stored(cells.withColumn("__shard_base", F.coalesce(F.sum(F.size("__shard_bounds")).over(before), F.lit(0))), "shard-cells")

    # overfull ranges: keys over a range's share become pieces of their own; at most `ranges` keys can
    ranged = _placed(slim, cells, None)
    overfull = ranged.groupBy("__shard_range").agg(F.sum("__shard_size").alias("bytes")).where(F.col("bytes") > 1.5 * share).select("__shard_range")
    heavy = ranged.join(F.broadcast(overfull), "__shard_range", "left_semi").groupBy(F.col("__shard_key").alias("__shard_heavy")).agg(F.sum("__shard_size").alias("bytes")).where(F.col("bytes") > share)
    heavy = stored(heavy.select("__shard_heavy", F.ceil(F.col("bytes") / share).alias("__shard_parts"), (F.col("bytes") > quota).alias("__shard_split")), "shard-heavy")

    unit = ["__shard_range", "__shard_heavy", "__shard_sub"]
    units = _placed(slim, cells, heavy).groupBy(*unit).agg(F.sum("__shard_size").alias("bytes"), F.count("*").alias("n"))
    units = units.join(F.broadcast(heavy.select("__shard_heavy", "__shard_split")), "__shard_heavy", "left")
    # a piece stays together: a range, a heavy key, or one part of a key that no shard can hold
    part = F.when(F.col("__shard_split"), F.col("__shard_sub"))
    units = stored(units.select(*unit, part.alias("part"), "bytes", "n"), "shard-units")
    piece = ["__shard_range", "__shard_heavy", "part"]
    pieces = units.groupBy(*piece).agg(F.sum("bytes").alias("bytes"))

    # large pieces: at most 32 a shard, since each exceeds a 32nd of a quota
    large = pieces.where(F.col("bytes") > quota / 32)
    entries = large.agg(F.sort_array(F.collect_list(F.struct("bytes", *piece)), asc=False).alias("e"))
    loads = F.array_repeat(F.lit(0).cast("long"), shards)

    def place(acc, e):
        k = F.array_position(acc.loads, F.array_min(acc.loads))
        loads = F.transform(acc.loads, lambda v, i: F.when(i + 1 == k, v + e.bytes).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc.to, F.array((k - 1).cast("int"))).alias("to"))

    plan = stored(entries.select("e", F.aggregate("e", F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to")), place).alias("p")), "shard-large")
    loads = list((plan.select("p.loads").first() or [[0] * shards])[0])
    large = plan.select(F.explode(F.arrays_zip(F.col("e"), F.col("p.to").alias("to"))).alias("z")).select("z.e.*", F.col("z.to").alias("shard")).drop("bytes")

    # the rest fills what is free, in the order of the keys
    room = [max(0.0, quota - x) for x in loads]
    free, upto = sum(room) or 1.0, []
    for x in room:
        upto.append((upto[-1] if upto else 0.0) + x / free)
    small = pieces.where(F.col("bytes") <= quota / 32)
    order = Window.orderBy("__shard_range", F.col("__shard_heavy").asc_nulls_first(), F.col("part").asc_nulls_first())  # a bounded number of pieces
    middle = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") / 2
    at = middle / F.sum("bytes").over(Window.partitionBy())
    ends = F.array(*[F.lit(float(x)) for x in upto])
    small = small.withColumn("__at", at).select(*piece, F.least(F.lit(shards - 1), F.size(F.filter(ends, lambda u: u <= F.col("__at")))).cast("int").alias("shard"))
    homes = small.unionByName(large.select(*piece, "shard"))
    homes = homes.select(*[F.col(c).alias(f"{c}_p") for c in piece], "shard")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_p")) for c in piece]
    homed = units.join(F.broadcast(homes), same[0] & same[1] & same[2]).select(*unit, "n", "shard")
    before = Window.partitionBy("shard").orderBy("__shard_range", F.col("__shard_heavy").asc_nulls_first(), "__shard_sub").rowsBetween(Window.unboundedPreceding, -1)
    homed = stored(homed.withColumn("__shard_offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shard-homes")

    rows = _placed(full, cells, heavy)
    renamed = homed.select(*[F.col(c).alias(f"{c}_h") for c in unit], F.col("shard").alias("__shard_no"), "__shard_offset")
    on = [F.col(c).eqNullSafe(F.col(f"{c}_h")) for c in unit]
    rows = rows.join(F.broadcast(renamed), on[0] & on[1] & on[2])
    slot = F.row_number().over(Window.partitionBy(*unit).orderBy("__shard_key", "__shard_id")) - 1
    rows = rows.withColumn("slot", (F.col("__shard_offset") + slot).cast("long")).withColumn("shard", F.col("__shard_no"))
    return rows.drop(*unit, *[f"{c}_h" for c in unit], "__shard_no", "__shard_offset")


def shard_index(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every document, without moving the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(F.col(id_col), F.xxhash64(text).alias("__shard_key"), F.col(id_col).cast("string").alias("__shard_id"), record_size(F.col(text_col)).alias("__shard_size"), F.crc32(text).alias("text_crc32")),
        "shard-keys",
    )
    out = _assigned(slim.select("__shard_key", "__shard_id", "__shard_size"), slim, shards, seed)
    return out.select(id_col, F.col("__shard_size").alias("size"), "text_crc32", "shard", "slot")
