"""Operators on series: a table with key columns, a time ``t`` and a value ``x`` (names are parameters).

Most are windows by key. A series may be longer than a task should hold: those that look at neighbours, at anchors or at
what came before (differences, gaps, segments, running sums, ``beside`` and all that rests on it) cut series of more than CHUNK_ROWS rows
into stretches of time (``in_chunks``), work on each alone, and carry over from stretch to stretch what the next needs: the last row, the last
anchor, a sum. Nothing is collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_time(keys: list[str], t: str = "t"):
    return Window.partitionBy(*keys).orderBy(t)


# --- long series -----------------------------------------------------------------------------------

#: Rows of a series that a task takes at once, and the equal cells of time that a longer one is counted in.
CHUNK_ROWS, CELLS = 1_000_000, 1 << 16


def in_chunks(df: DataFrame, keys: list[str], t: str = "t", rows: int | None = None) -> DataFrame:
    """Adds __k, the keys as one value, and __chunk, the stretch of its series that a row is in: 0 for series of up to rows rows; longer ones
    are counted by CELLS cells of time, and a stretch ends with the cell in which its rows are full. Rows of one time are in one
    stretch. Counts and ends do not depend on the order of rows, so a task that runs again gives the same."""
    rows = CHUNK_ROWS if rows is None else rows
    d = df.withColumn("__k", F.struct(*keys))
    time = F.col(t).cast("double")
    long = d.groupBy("__k").agg(F.count(t).alias("__c"), F.min(time).alias("__t0"), F.max(time).alias("__t1")).where(f"__c > {rows} AND __t1 > __t0").drop("__c")
    cell = F.least(F.lit(CELLS - 1), F.floor((time - F.col("__t0")) / (F.col("__t1") - F.col("__t0")) * CELLS)).cast("int")
    counts = d.join(long, "__k").groupBy("__k", "__t0", "__t1", cell.alias("cell")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("__k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows at most
    counts = counts.withColumn("chunk", F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) / rows))
    starts = counts.groupBy("__k", "__t0", "__t1", "chunk").agg(F.min("cell").alias("cell"))
    starts = starts.groupBy("__k", "__t0", "__t1").agg(F.array_sort(F.collect_list("cell")).alias("__starts"))
    placed = d.join(starts, "__k", "left").withColumn("__cell", F.coalesce(cell, F.lit(0)))
    chunk = F.when(F.col("__starts").isNull(), 0).otherwise(F.size(F.filter("__starts", lambda s: s <= F.col("__cell"))))
    return placed.withColumn("__chunk", chunk).drop("__t0", "__t1", "__starts", "__cell")


def with_neighbours(df: DataFrame, keys: list[str], columns: list[str], t: str = "t", rows: int | None = None) -> DataFrame:
    """Adds __before and __after: the given columns of the rows next to each row of its series, as structs; null at its ends."""
    d, here, w = in_chunks(df, keys, t, rows), F.struct(*columns), Window.partitionBy("__k", "__chunk").orderBy(t)
    d = d.withColumn("__before", F.lag(here).over(w)).withColumn("__after", F.lead(here).over(w)).withColumn("__place", F.row_number().over(w))
    last = F.first(F.when(F.col("__after").isNull(), here), ignorenulls=True)
    edges = d.where("__chunk > 0 OR __after IS NULL").where("__place = 1 OR __after IS NULL").groupBy("__k", "__chunk").agg(F.first(F.when(F.col("__place") == 1, here), ignorenulls=True).alias("first"), last.alias("last"))
    whole = Window.partitionBy("__k").orderBy("__chunk")  # a row for each stretch
    edges = edges.withColumn("__last", F.lag("last").over(whole)).withColumn("__first", F.lead("first").over(whole)).where("__last IS NOT NULL OR __first IS NOT NULL").select("__k", "__chunk", "__last", "__first")
    d = d.join(edges, ["__k", "__chunk"], "left")
    return d.withColumn("__before", F.coalesce("__before", "__last")).withColumn("__after", F.coalesce("__after", "__first")).drop("__last", "__first", "__place", "__k", "__chunk")


def running_sum(df: DataFrame, keys: list[str], value: Column, out: str, t: str = "t", rows: int | None = None, total: str | None = None) -> DataFrame:
    """Adds the sum of value over its series' rows up to each row, in the order of t; with total also the whole sum."""
    d, chunk = in_chunks(df, keys, t, rows).withColumn("__v", value), Window.partitionBy("__k", "__chunk")
    sums = d.groupBy("__k", "__chunk").agg(F.sum("__v").alias("__s"))
    whole = Window.partitionBy("__k")  # a row for each stretch
    carried = sums.withColumn("__carry", F.sum("__s").over(whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))).withColumn("__total", F.sum("__s").over(whole)).drop("__s")
    d = d.join(carried, ["__k", "__chunk"])
    own = F.sum("__v").over(chunk.orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn(out, F.when(F.col("__carry").isNull(), own).otherwise(F.coalesce(own, F.lit(0).cast(df.select(value).schema[0].dataType)) + F.col("__carry")))
    if total is not None:
        d = d.withColumn(total, F.col("__total"))
    return d.drop("__k", "__chunk", "__v", "__carry", "__total")


# --- differences and grids ---------------------------------------------------------------------------


def central_difference(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", out: str = "dxdt") -> DataFrame:
    """Interior rows with (x[i+1] - x[i-1]) / (t[i+1] - t[i-1])."""
    d = with_neighbours(df, keys, list(dict.fromkeys([t, x])), t).where("__before IS NOT NULL AND __after IS NOT NULL")
    slope = (F.col("__after")[x] - F.col("__before")[x]) / (F.col("__after")[t] - F.col("__before")[t])
    return d.withColumn(out, slope).drop("__before", "__after")


def central_difference_arrays(df: DataFrame, keys: list[str], t: str = "t", state: str = "state", out: str = "derivative") -> DataFrame:
    """The same for array-valued states, one row per time."""
    d = with_neighbours(df, keys, [t, state], t).where("__before IS NOT NULL AND __after IS NOT NULL")
    span = F.col("__after")[t] - F.col("__before")[t]
    return d.withColumn(out, F.zip_with(F.col("__before")[state], F.col("__after")[state], lambda a, b: (b - a) / span)).drop("__before", "__after")


def nodal_derivative(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", out: str = "dxdt") -> DataFrame:
    """Mean of the slopes on both sides; at the ends the one slope there is."""
    d = with_neighbours(df, keys, list(dict.fromkeys([t, x])), t)
    back = (F.col(x) - F.col("__before")[x]) / (F.col(t) - F.col("__before")[t])
    ahead = (F.col("__after")[x] - F.col(x)) / (F.col("__after")[t] - F.col(t))
    return d.withColumn(out, F.when(back.isNull(), ahead).when(ahead.isNull(), back).otherwise((ahead + back) / 2)).drop("__before", "__after")


def subsample(df: DataFrame, keys: list[str], factor: int, t: str = "t", keep_last: bool = True, horizon: float | None = None) -> DataFrame:
    """Every factor-th row of each series, with the last row too (keep_last) or rows up to a horizon only."""
    w = by_time(keys, t)
    df = df.withColumn("__i", F.row_number().over(w) - 1)
    keep = F.col("__i") % factor == 0
    if keep_last:
        keep = keep | (F.col("__i") == F.count("*").over(Window.partitionBy(*keys)) - 1)
        df = df.withColumn("__k", keep).where("__k").drop("__k")
    else:
        df = df.where(keep)
    if horizon is not None:
        df = df.where(F.col(t) <= horizon + 1e-10)
    return df.drop("__i")


def gaps(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Adds gap, the time since the row before."""
    return with_neighbours(df, keys, [t], t).withColumn("gap", F.col(t) - F.col("__before")[t]).drop("__before", "__after")


def nominal_pairs(df: DataFrame, keys: list[str], t: str = "t", rtol: float = 1e-7, atol: float = 1e-12) -> DataFrame:
    """Rows with the row before, the median gap of the series, and whether the gap is close to it (usable)."""
    w = by_time(keys, t)
    df = df.withColumn("t_prev", F.lag(t).over(w)).where("t_prev IS NOT NULL").withColumn("gap", F.col(t) - F.col("t_prev"))
    df = df.withColumn("nominal", F.percentile("gap", 0.5).over(Window.partitionBy(*keys)))
    return df.withColumn("usable", F.abs(F.col("gap") - F.col("nominal")) <= F.lit(atol) + F.lit(rtol) * F.abs("nominal"))


def irregular_series(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Keys whose times do not strictly increase; such series have no nominal pairs."""
    g = gaps(df, keys, t).where("gap <= 0")
    return g.select(*keys).distinct()


def dense_grid(df: DataFrame, keys: list[str], q: int, t: str = "t") -> DataFrame:
    """(keys, i, t): steps of the first gap / q, up to a tenth of a step beyond the last time."""
    two = Window.partitionBy(*keys).orderBy(t)
    ends = df.withColumn("__n", F.row_number().over(two)).groupBy(*keys).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.min(F.when(F.col("__n") == 2, F.col(t))).alias("__t2")).where("__t2 IS NOT NULL")
    step = (F.col("__t2") - F.col("__t0")) / q
    count = F.ceil((F.col("__t1") + 0.1 * step - F.col("__t0")) / step).cast("int")
    return ends.select(*keys, F.explode(F.sequence(F.lit(0), count - 1)).alias("i"), F.col("__t0"), step.alias("__s")).select(*keys, "i", (F.col("__t0") + F.col("i") * F.col("__s")).alias("t"))


def dense_grid_exact(df: DataFrame, keys: list[str], q: int, t: str = "t") -> DataFrame:
    """(keys, i, t): q (n - 1) + 1 equal steps from the first time to the last."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.count("*").cast("int").alias("__n")).where("__n > 1")
    m = F.col("__n") * q - q
    return ends.select(*keys, "__t0", "__t1", m.alias("__m"), F.explode(F.sequence(F.lit(0), m)).alias("i")).select(*keys, "i", (F.col("__t0") + (F.col("__t1") - F.col("__t0")) * F.col("i") / F.col("__m")).alias("t"))


def beside(queries: DataFrame, anchors: DataFrame, keys: list[str], t: str, x: str, rows: int | None = None) -> DataFrame:
    """queries with the anchors before (or at) and after: t_prev, x_prev, i_prev (its number from 0), t_next, x_next, i_next. Queries and
    anchors of a stretch of time are put in order together; the last and first anchors of other stretches are carried over."""
    a = anchors.select(*keys, F.col(t).alias("t"), F.struct(F.col(t).alias("t"), F.col(x).alias("x")).alias("__a"), F.lit(0).alias("__q"))
    q = queries.select(*keys, F.col(t).alias("t"), F.lit(None).cast(a.schema["__a"].dataType).alias("__a"), F.lit(1).alias("__q"))
    both, chunk = in_chunks(a.unionByName(q), keys, "t", rows), Window.partitionBy("__k", "__chunk")
    prev = chunk.orderBy("t", "__q").rowsBetween(Window.unboundedPreceding, 0)
    after = chunk.orderBy(F.col("t").desc(), F.col("__q").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__p", F.last("__a", ignorenulls=True).over(prev)).withColumn("__i", F.count("__a").over(prev)).withColumn("__n", F.last("__a", ignorenulls=True).over(after))
    least = both.where("__q = 0").groupBy("__k", "__chunk").agg(F.min_by("__a", "t").alias("first"), F.max_by("__a", "t").alias("last"), F.count("*").alias("c"))
    stretches = both.select("__k", "__chunk").distinct().join(least, ["__k", "__chunk"], "left")
    order = Window.partitionBy("__k").orderBy("__chunk")  # a row for each stretch
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = stretches.select("__k", "__chunk", F.last("last", ignorenulls=True).over(earlier).alias("__last"), F.first("first", ignorenulls=True).over(later).alias("__first"), F.sum("c").over(earlier).alias("__c"))
    carried = carried.where("__last IS NOT NULL OR __first IS NOT NULL")
    both = both.where("__q = 1").join(carried, ["__k", "__chunk"], "left").withColumn("__i", F.col("__i") + F.coalesce("__c", F.lit(0)))
    both = both.withColumn("__p", F.coalesce("__p", "__last")).withColumn("__n", F.coalesce("__n", "__first"))
    place = F.when(F.col("__p").isNotNull(), F.col("__i") - 1).cast("int").alias("i_prev"), F.when(F.col("__n").isNotNull(), F.col("__i")).cast("int").alias("i_next")
    return both.select(*keys, "t", F.col("__p.t").alias("t_prev"), F.col("__p.x").alias("x_prev"), place[0], F.col("__n.t").alias("t_next"), F.col("__n.x").alias("x_next"), place[1])


def asof_anchor(queries: DataFrame, anchors: DataFrame, keys: list[str], t: str = "t", x: str = "x", tolerance: float = 1e-10) -> DataFrame:
    """Each query time with the last anchor at or before it. An anchor that is later by tolerance * max(1, |t|) at most, as
    sums of steps are, counts as at it."""
    b = beside(queries, anchors, keys, t, x)
    late = F.col("t_next").isNotNull() & (F.col("t_next") - F.col("t") <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("t")))
    took = [F.when(late, F.col(f"{c}_next")).otherwise(F.col(f"{c}_prev")).alias(f"{c}_prev") for c in ("t", "x", "i")]
    return b.select(*keys, "t", *took).where("t_prev IS NOT NULL")


def nearest_anchor(queries: DataFrame, anchors: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Each query time with the nearest anchor, the earlier one on ties."""
    b = beside(queries, anchors, keys, t, x)
    use_prev = F.col("t_next").isNull() | (F.col("t") - F.col("t_prev") <= F.col("t_next") - F.col("t"))
    return b.select(*keys, "t", F.when(use_prev, F.col("t_prev")).otherwise(F.col("t_next")).alias("t_near"), F.when(use_prev, F.col("x_prev")).otherwise(F.col("x_next")).alias("x_near"), F.when(use_prev, F.col("i_prev")).otherwise(F.col("i_next")).alias("i_near"))


def linear_interp(queries: DataFrame, anchors: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Each query time with the value on the line between its anchors; beyond the ends the end's value."""
    b = beside(queries, anchors, keys, t, x)
    inside = F.col("x_prev") + (F.col("x_next") - F.col("x_prev")) * (F.col("t") - F.col("t_prev")) / (F.col("t_next") - F.col("t_prev"))
    value = F.when(F.col("t_prev").isNull(), F.col("x_next")).when(F.col("t_next").isNull() | (F.col("t_prev") == F.col("t_next")), F.col("x_prev")).otherwise(inside)
    return b.select(*keys, "t", value.alias("x"))


def interior_folds(df: DataFrame, keys: list[str], k: int, t: str = "t") -> DataFrame:
    """Adds fold: interior rows go round k folds, ends have none (-1). Series with fewer than 6 rows are left out;
    k is at most the number of interior rows and at least 2."""
    n = F.count("*").over(Window.partitionBy(*keys))
    df = df.withColumn("__i", F.row_number().over(by_time(keys, t)) - 1).withColumn("__n", n).where("__n >= 6")
    folds = F.greatest(F.lit(2), F.least(F.lit(k), F.col("__n") - 2))
    return df.withColumn("fold", F.when((F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1), -1).otherwise((F.col("__i") - 1) % folds).cast("int")).drop("__i", "__n")


def fold_interp_mse(df: DataFrame, keys: list[str], k: int, t: str = "t", x: str = "x", eps: float = 1e-12) -> DataFrame:
    """(keys, fold, mse): held-out rows against linear interpolation of the others, over the variance of the others.

    The neighbours of a held-out row are in other folds, as there are two at least; so the guess is a window's, and the
    others' variance is the sums of all less those of the fold. One shuffle by key."""
    f = interior_folds(df.select(*keys, F.col(t).alias("t"), F.col(x).alias("x")), keys, k)
    w, whole = by_time(keys), Window.partitionBy(*keys)
    f = f.withColumn("__m", F.avg("x").over(whole)).withColumn("__c", F.col("x") - F.col("__m"))
    t0, t1, x0, x1 = F.lag("t").over(w), F.lead("t").over(w), F.lag("x").over(w), F.lead("x").over(w)
    f = f.withColumn("__guess", F.when(t1 == t0, x0).otherwise(x0 + (x1 - x0) * (F.col("t") - t0) / (t1 - t0)))
    g = f.groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.sum("__c").alias("s"), F.sum(F.col("__c") ** 2).alias("q"), F.avg((F.col("__guess") - F.col("x")) ** 2).alias("e"))
    for c in ("n", "s", "q"):
        g = g.withColumn(f"__{c}", F.sum(c).over(whole) - F.col(c))
    spread = F.col("__q") / F.col("__n") - (F.col("__s") / F.col("__n")) ** 2
    return g.where("fold >= 0").select(*keys, "fold", (F.col("e") / F.greatest(spread, F.lit(eps))).alias("mse"))


def delay_embedding(df: DataFrame, keys: list[str], delays: int, t: str = "t", x: str = "x") -> DataFrame:
    """(keys, t, x0 .. x{delays-1}): each value with those after it; rows without enough of them are left out."""
    w = by_time(keys, t)
    cols = [F.lead(x, d).over(w).alias(f"x{d}") if d else F.col(x).alias("x0") for d in range(delays)]
    out = df.select(*keys, F.col(t).alias("t"), *cols, F.lead(t, delays - 1).over(w).alias("__last") if delays > 1 else F.col(t).alias("__last"))
    return out.where("__last IS NOT NULL").drop("__last")


def standardize_train(df: DataFrame, keys: list[str], train: Column, x: str = "x", out: str = "z", floor: float = 1e-12) -> DataFrame:
    """Adds mean, std and z = (x - mean) / std, from training rows only; held-out rows have z = 0."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__train", train)
    value = F.when(F.col("__train"), F.col(x))
    df = df.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.greatest(F.stddev_pop(value).over(w), F.lit(floor)))
    return df.withColumn(out, F.when(F.col("__train"), (F.col(x) - F.col("mean")) / F.col("std")).otherwise(0.0)).drop("__train")


def unstandardize(df: DataFrame, z: str = "z", dz: str | None = None) -> DataFrame:
    """Adds x = z * std + mean, and dx = dz * std (the mean plays no part in a derivative)."""
    df = df.withColumn("x", F.col(z) * F.col("std") + F.col("mean"))
    return df if dz is None else df.withColumn("dx", F.col(dz) * F.col("std"))


def normalized_time(df: DataFrame, keys: list[str], t: str = "t", out: str = "tau", eps: float = 1e-12) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn(out, (F.col(t) - F.min(t).over(w)) / F.greatest(F.max(t).over(w) - F.min(t).over(w), F.lit(eps)))


def noise_sigma(df: DataFrame, keys: list[str], channel: str, x: str = "x", rel: float = 0.1, eps: float = 1e-12) -> DataFrame:
    """(keys, channel, sigma): rel times each channel's sample deviation, or the population deviation of all values of the
    series where that is 0 or a channel has one value only."""
    w = Window.partitionBy(*keys)
    each = df.groupBy(*keys, channel).agg(F.stddev_samp(x).alias("s"), F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    n, mean = F.sum("n").over(w), F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    each = each.withColumn("__n", n).withColumn("__m", mean)
    within = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("__m")) ** 2)).over(w)
    whole = F.greatest(F.sqrt(within / F.col("__n")), F.lit(eps))
    return each.select(*keys, channel, (F.lit(rel) * F.when(F.coalesce("s", F.lit(0.0)) < eps, whole).otherwise(F.col("s"))).alias("sigma"))


def noise_sigma_global(df: DataFrame, keys: list[str], x: str = "x", rel: float = 0.1, eps: float = 1e-12) -> DataFrame:
    """(keys, sigma): rel times the population deviation over everything in the series."""
    return df.groupBy(*keys).agg((F.lit(rel) * F.greatest(F.stddev_pop(x), F.lit(eps))).alias("sigma"))


def normal_draw(*counter) -> Column:
    """A standard normal number that depends on the given values alone: two uniform ones from the halves of their MD5, turned by
    Box and Muller. Rows with other values are independent, whatever task they are in."""
    name = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(c) if isinstance(c, str) else c for c in counter)]))

    def part(start: int) -> Column:  # 52 bits, never 0
        return (F.conv(F.substring(name, start, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(part(1))) * F.cos(2 * math.pi * part(14))


def add_noise(df: DataFrame, keys: list[str], row: str, seed: Column, rel: float, channel: str | None = None, x: str = "x", out: str = "noisy") -> DataFrame:
    """Adds x with a draw of its channel's deviation (``noise_sigma``), or of the whole series' without a channel (``noise_sigma_global``). The
    draw is named by seed, keys, channel and row, which tells the rows of a channel apart, so that a record with one seed has one noise; x itself
    where rel is not above 0."""
    if rel <= 0:
        return df.withColumn(out, F.col(x).cast("double"))
    on = [*keys, channel] if channel else list(keys)
    sigma = noise_sigma(df, keys, channel, x, rel) if channel else noise_sigma_global(df, keys, x, rel)
    named = sigma.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(on)], F.col("sigma").alias("__sigma"))
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return df.join(named, same).withColumn(out, F.col(x) + F.col("__sigma") * normal_draw(seed, *on, row)).drop(*[f"__{i}" for i in range(len(on))], "__sigma")


def segment_id(df: DataFrame, keys: list[str], anchor: Column, t: str = "t", out: str = "segment") -> DataFrame:
    """Adds the number of anchors so far."""
    return running_sum(df, keys, anchor.cast("long"), out, t)


def cumulative_energy(df: DataFrame, keys: list[str], order: str, x: str = "x", out: str = "fraction") -> DataFrame:
    """Adds the share of the sum of squares up to each row."""
    d = running_sum(df, keys, F.col(x).cast("double") ** 2, "__run", order, total="__whole")
    return d.withColumn(out, F.col("__run") / F.greatest(F.col("__whole"), F.lit(1e-300))).drop("__run", "__whole")


def energy_rank(df: DataFrame, keys: list[str], order: str, x: str = "x", energy: float = 0.99, cap: int = 10) -> DataFrame:
    """(keys, rank): the first number of leading rows with the wanted share of energy, at most cap; 1 without energy."""
    c = cumulative_energy(df, keys, order, x)
    return c.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.lit(cap), F.sum((F.col("fraction") < energy).cast("int")) + 1)).cast("int").alias("rank"))


def _moments(power: int, derivative: int):
    """Antiderivatives of g and s g as polynomials of s, g the derivative of (1 - s**2)**power of that order (0 or 1)."""
    test = {2 * i: math.comb(power, i) * (-1.0) ** i for i in range(power + 1)}
    if derivative:
        test = {d - 1: d * c for d, c in test.items() if d}
    return {d + 1: c / (d + 1) for d, c in test.items()}, {d + 2: c / (d + 2) for d, c in test.items()}


def polynomial(s: Column, terms: dict[int, float]) -> Column:
    """The polynomial with these coefficients by degree, by Horner's rule."""
    out = F.lit(0.0)
    for d in range(max(terms), -1, -1):
        out = out * s + F.lit(terms.get(d, 0.0))
    return out


def weak_windows(df: DataFrame, keys: list[str], halfwidth: float, stride: float, t: str = "t", x: str = "x", power: int = 4) -> DataFrame:
    """(keys, j, center, integral, target, n): integrals of x * (1 - s**2)**power and of -x times its derivative over
    overlapping windows that lie within the series, s the time from the center over halfwidth; n pieces in each."""
    return weak_window_columns(df, keys, halfwidth, stride, {x: "integral"}, {x: "target"}, t, power)


def weak_window_columns(df: DataFrame, keys: list[str], halfwidth: float, stride: float, integrals: dict[str, str], targets: dict[str, str], t: str = "t", power: int = 4) -> DataFrame:
    """(keys, j, center, ..., n) with the windows' integrals of several columns (column: name of its integral) and targets.

    The integrals are exact for the line through the samples: each piece between two samples, cut at the window's ends, has
    closed moments. A piece meets a bounded number of windows, so the join is an explode, not a range join."""
    ends, w, values = Window.partitionBy(*keys), by_time(keys, t), list(dict.fromkeys([*integrals, *targets]))
    now, then = {c: f"__x{i}" for i, c in enumerate(values)}, {c: f"__y{i}" for i, c in enumerate(values)}
    both = [F.col(c).alias(now[c]) for c in values] + [F.lead(c).over(w).alias(then[c]) for c in values]
    df = df.select(*keys, F.col(t).alias("t"), *both, F.lead(t).over(w).alias("__t"), F.min(t).over(ends).alias("__t0"), F.max(t).over(ends).alias("__t1"))
    last = F.floor((F.col("__t1") - F.col("__t0") - 2 * halfwidth) / stride + 1e-9)
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - F.col("__t0") - 2 * halfwidth) / stride - 1e-9)).cast("int")
    high = F.least(last, F.floor((F.col("__t") - F.col("__t0")) / stride + 1e-9)).cast("int")
    df = df.where("__t > t").withColumn("__low", low).withColumn("__high", high).where("__high >= __low")
    each = df.withColumn("j", F.explode(F.sequence("__low", "__high"))).withColumn("center", F.col("__t0") + halfwidth + F.col("j") * stride)
    each = each.withColumn("s0", (F.col("t") - F.col("center")) / halfwidth).withColumn("s1", (F.col("__t") - F.col("center")) / halfwidth)
    each = each.withColumn("lo", F.greatest(F.col("s0"), F.lit(-1.0))).withColumn("hi", F.least(F.col("s1"), F.lit(1.0))).where("hi > lo")

    for derivative in (0, 1):
        for name, terms in zip(("whole", "first"), _moments(power, derivative)):
            each = each.withColumn(f"__{name}{derivative}", polynomial(F.col("hi"), terms) - polynomial(F.col("lo"), terms))

    def piece(c: str, derivative: int) -> Column:
        i0, i1 = F.col(f"__whole{derivative}"), F.col(f"__first{derivative}")
        return (F.col(now[c]) * (F.col("s1") * i0 - i1) + F.col(then[c]) * (i1 - F.col("s0") * i0)) / (F.col("s1") - F.col("s0"))

    sums = [(F.sum(piece(c, 0)) * halfwidth).alias(name) for c, name in integrals.items()] + [(-F.sum(piece(c, 1))).alias(name) for c, name in targets.items()]
    return each.groupBy(*keys, "j", "center").agg(*sums, F.count("*").alias("n"))


def periodic_weights(n: int, length: float, centers: list[float], halfwidth: float, derivative: int = 0, power: int = 4) -> np.ndarray:
    """[centers, n]: what the samples of a periodic field at i * length / n weigh in the integrals, over windows of that half width that may wrap
    round, of the line through them times a derivative of (1 - s**2)**power."""
    if not 0 < halfwidth < length / 2:
        raise ValueError("a window must be narrower than the period")
    test = np.polynomial.Polynomial([1.0, 0.0, -1.0]) ** power
    test = test.deriv(derivative) if derivative else test
    whole, first = test.integ(), (test * np.polynomial.Polynomial([0.0, 1.0])).integ()
    cells, step = np.arange(-n, 2 * n), length / n
    out = np.zeros((len(centers), n))
    for row, c in zip(out, centers):
        s0, s1 = (cells * step - c) / halfwidth, ((cells + 1) * step - c) / halfwidth
        lo, hi = np.clip(s0, -1, 1), np.clip(s1, -1, 1)
        i0, i1 = whole(hi) - whole(lo), first(hi) - first(lo)
        np.add.at(row, cells % n, (s1 * i0 - i1) / (s1 - s0))
        np.add.at(row, (cells + 1) % n, (i1 - s0 * i0) / (s1 - s0))
    return out * halfwidth ** (1 - derivative)


WEAK_TERMS = ("1", "u", "u*u", "u_x", "u*u_x", "u*u*u_x", "u_xx", "(u*u)_xx")


def weak_fields(df: DataFrame, keys: list[str], length: float, halfwidth: float, stride: float, centers: list[float], space_halfwidth: float, field: str = "field", t: str = "t", power: int = 4) -> DataFrame:
    """(keys, j, center, space, f0 .. f7, target, n): the integrals of the eight terms of WEAK_TERMS and of -u_t against products of
    test functions in time (as ``weak_windows``) and in periodic space, over the norm of the test. No data are differentiated:
    derivatives go to the test function, and u*u_x, u*u*u_x are those of u*u/2, u*u*u/3.

    The window functions are products, so that each field is first contracted in space, a matrix product for each batch with weights of
    len(centers) x field size numbers, and then in time, piece by piece. Fields of another size than the series' first, null ones and such with nulls or NaN
    are left out."""
    rows = df.select(*keys, F.col(t).alias("t"), F.col(field).cast("array<double>").alias("u"))
    good = F.forall("u", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = rows.where(F.coalesce(good, F.lit(False)) & (F.size("u") > 1)).withColumn("__n", F.min_by(F.size("u"), "t").over(Window.partitionBy(*keys))).where(F.size("u") == F.col("__n"))

    def run(parts):
        weights: dict[int, list[np.ndarray]] = {}
        for part in parts:
            out = [np.zeros((0, 8))]
            index, space = [], []
            for n, some in part.groupby("__n", sort=False):
                if n not in weights:
                    weights[n] = [periodic_weights(int(n), length, centers, space_halfwidth, d, power).T for d in (0, 1, 2)]
                w0, w1, w2 = weights[n]
                u = np.stack(some["u"].to_list())
                terms = (np.ones_like(u) @ w0, u @ w0, u * u @ w0, -(u @ w1), -(u * u @ w1) / 2, -(u**3 @ w1) / 3, u @ w2, u * u @ w2)
                out.append(np.stack(terms, 2).reshape(-1, 8))
                index += list(np.repeat(some.index, len(centers)))
                space += list(range(len(centers))) * len(some)
            flat = part.loc[index, [*keys, "t"]].reset_index(drop=True)
            flat.insert(len(keys), "space", np.array(space, np.int32))
            yield pd.concat([flat, pd.DataFrame(np.concatenate(out), columns=[f"a{i}" for i in range(8)])], axis=1)

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    flat = rows.mapInPandas(run, f"{kinds}space int, t {rows.schema['t'].dataType.simpleString()}, " + ", ".join(f"a{i} double" for i in range(8)))
    out = weak_window_columns(flat, [*keys, "space"], halfwidth, stride, {f"a{i}": f"f{i}" for i in range(8)}, {"a1": "target"}, "t", power)
    whole = sum(c * 2 for d, c in _moments(power, 0)[0].items())  # of the test function over -1 to 1: its antiderivative is odd
    norm = F.lit(whole * whole * halfwidth * space_halfwidth)
    return out.select(*keys, "j", "center", "space", *[(F.col(f"f{i}") / norm).alias(f"f{i}") for i in range(8)], (F.col("target") / norm).alias("target"), "n")
