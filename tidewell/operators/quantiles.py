"""Exact quantiles of groups of any size, by counting.

``percentile`` gathers a group's values in one task. Here a group's rank is found in three steps that each see bounded
tables: the distinct values are counted (a shuffle by group and value), the counts are added up by bins of the logarithm,
a bin that holds the wanted rank is divided evenly between its least and greatest value, and only the values of the
one small bin that is left are put in order. Bins, least and greatest values and counts do not depend on the order of
rows, so that a task that runs again gives the same. At most 2**22 bins of a group, or values of a bin, come to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a power of two, and bins that a chosen bin is divided into.
PER_BINADE, PARTS = 1024, 1 << 20


def clean(x: str | Column) -> Column:
    """x with NaN as null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _binade(v: Column) -> Column:
    """A number that never falls as v rises: 0 for 0, and PER_BINADE numbers for each power of two of either sign."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    place = (power + 1100) * PER_BINADE + F.floor((size / F.pow(F.lit(2.0), power) - 1) * PER_BINADE) + 1
    return F.when(v == 0, 0).when(size == float("inf"), F.signum(v) * (1 << 40)).otherwise(F.signum(v) * place).cast("long")


def _bin_of_rank(bins: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of bins (group, order, c, rank ...) the one that holds each group's rank, and the rank within it."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = bins.withColumn("__before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    return b.where((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("c"))).withColumn("rank", F.col("rank") - F.col("__before")).drop("__before", "c")


def quantiles(df: DataFrame, keys: list[str], metrics: dict[str, str | Column], q: float = 0.5) -> DataFrame:
    """(keys, a column for each name): the q-quantile of each metric in each group, on the line between neighbours in order, as ``percentile``
    has it. Nulls and NaN are missing; a group without any numbers has null; null keys are a group."""
    names = list(metrics)
    whole = df.select(F.struct(*keys).alias("g") if keys else F.struct(F.lit(0).alias("__all")).alias("g"), F.array(*[clean(m) for m in metrics.values()]).alias("vs"))
    rows = whole.select("g", F.posexplode("vs").alias("m", "v")).where("v IS NOT NULL").select("g", "m", (F.col("v") + 0.0).alias("v"))
    base = rows.groupBy("g", "m", "v").agg(F.count("*").alias("c")).withColumn("b", _binade(F.col("v")))

    coarse = base.groupBy("g", "m", "b").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = F.sum("c").over(Window.partitionBy("g", "m"))
    at = (n - 1) * F.lit(q)
    ends = F.array_distinct(F.array(F.struct(F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("share")), F.struct(F.ceil(at).alias("rank"), (at - F.floor(at)).alias("share"))))
    coarse = coarse.withColumn("e", ends).select("g", "m", "b", "c", "lo", "hi", F.posexplode(F.filter("e", lambda x: x["share"] > 0)).alias("k", "x")).select("g", "m", "k", "b", "c", "lo", "hi", F.col("x.rank").cast("long").alias("rank"), "x.share")
    chosen = _bin_of_rank(coarse, ["g", "m", "k"], "b")

    part = F.when(F.col("hi") > F.col("lo"), F.floor(F.least(F.lit(1.0), (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)) * PARTS)).otherwise(0)
    fine = base.join(chosen, ["g", "m", "b"]).withColumn("part", part)
    fine = fine.groupBy("g", "m", "k", "b", "rank", "share", "part").agg(F.sum("c").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
    chosen = _bin_of_rank(fine, ["g", "m", "k"], "part").drop("part")

    last = base.join(chosen, ["g", "m", "b"]).where((F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to")))
    found = _bin_of_rank(last.select("g", "m", "k", "v", "c", "rank", "share"), ["g", "m", "k"], "v")
    wide = found.groupBy("g").agg(*[F.sum(F.when(F.col("m") == i, F.col("v") * F.col("share"))).alias(f"__q{i}") for i in range(len(names))])
    groups = whole.select("g").distinct()
    out = groups.join(wide, "g", "left")
    return out.select(*([F.col(f"g.{k}").alias(k) for k in keys]), *[F.col(f"__q{i}").alias(name) for i, name in enumerate(names)])


def with_quantiles(df: DataFrame, keys: list[str], aggregates: list[Column], medians: dict[str, str | Column], q: float = 0.5) -> DataFrame:
    """df grouped by keys with the aggregates and, beside them, the quantiles."""
    found = quantiles(df, keys, medians, q)
    if not keys:
        return df.agg(*aggregates).crossJoin(F.broadcast(found))  # one row each
    renamed = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *medians)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.groupBy(*keys).agg(*aggregates).join(renamed, on).drop(*[f"__k{i}" for i in range(len(keys))])
