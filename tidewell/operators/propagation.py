"""Propagation of a series between its observations by the map that takes an observation to the next.

The map is fitted to the pairs of observations one nominal lag apart, on the observables 1 and x: x -> a x + b. Its real
powers carry an observation over any part of the lag, so that every strategy is a row expression over the anchors before
and after a query time; nothing is iterated, and a series is never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series as S

#: A multiplier nearer to 0 than this is taken as this.
FLOOR = 1e-12


def one_step_map(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", rtol: float = 1e-7, alpha: float = 1e-8) -> DataFrame:
    """(keys, a, b, nominal, n): ridge regression of each observation on the one before, over pairs with the nominal lag."""
    w = S.by_time(keys, t)
    before = df.withColumn("__x0", F.lag(x).over(w))
    p = S.nominal_pairs(before, keys, t, rtol=rtol).where("usable").select(*keys, "nominal", F.col("__x0").alias("u"), F.col(x).alias("v"))
    g = p.groupBy(*keys, "nominal").agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum(F.col("u") * F.col("u")).alias("suu"), F.sum("v").alias("sv"), F.sum(F.col("u") * F.col("v")).alias("suv"))
    m00, m11 = F.col("n") + F.lit(alpha), F.col("suu") + F.lit(alpha)
    det = m00 * m11 - F.col("su") * F.col("su")
    a, b = (m00 * F.col("suv") - F.col("su") * F.col("sv")) / det, (m11 * F.col("sv") - F.col("su") * F.col("suv")) / det
    return g.select(*keys, a.alias("a"), b.alias("b"), "nominal", "n")


def advance(x: Column, a: Column, b: Column, fraction: Column) -> Column:
    """x after so many steps of x -> a x + b, the real part of the principal power; steps may be broken or negative."""
    a = F.when(F.abs(a) < FLOOR, F.lit(FLOOR)).otherwise(a)
    power = F.pow(F.abs(a), fraction) * F.when(a < 0, F.cos(fraction * math.pi)).otherwise(1.0)
    shift = F.when(F.abs(1 - a) < FLOOR, fraction).otherwise((1 - power) / F.when(F.abs(1 - a) < FLOOR, 1.0).otherwise(1 - a))
    return power * x + b * shift


STRATEGIES = ("local_reset", "global_rollout", "residual_corrected", "two_sided")


def propagate(queries: DataFrame, anchors: DataFrame, keys: list[str], strategy: str = "local_reset", maps: DataFrame | None = None, t: str = "t", x: str = "x") -> DataFrame:
    """(keys, t, x) at the query times within the observed window.

    local_reset advances the anchor before; global_rollout the first anchor; residual_corrected is the rollout and what it
    misses at the anchors around, on the line between them; two_sided blends the anchor before, advanced, with the anchor
    after, taken back, by the place between them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy} is none of {', '.join(STRATEGIES)}")
    maps = one_step_map(anchors, keys, t, x) if maps is None else maps
    first = anchors.groupBy(*keys).agg(F.min(F.struct(F.col(t).alias("t"), F.col(x).alias("x"))).alias("__first"))
    b = S.beside(queries, anchors, keys, t, x).where("t_prev IS NOT NULL AND (t_next IS NOT NULL OR t_prev = t)")
    b = b.join(maps.select(*keys, F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("nominal").alias("__h")), keys).join(first, keys)
    a, c, h = F.col("__a"), F.col("__b"), F.col("__h")

    def rolled(time: Column) -> Column:
        return advance(F.col("__first.x"), a, c, (time - F.col("__first.t")) / h)

    forward = advance(F.col("x_prev"), a, c, (F.col("t") - F.col("t_prev")) / h)
    inside = F.col("t_next") > F.col("t_prev")
    place = F.when(inside, (F.col("t") - F.col("t_prev")) / F.when(inside, F.col("t_next") - F.col("t_prev"))).otherwise(0.0)
    if strategy == "local_reset":
        out = forward
    elif strategy == "global_rollout":
        out = rolled(F.col("t"))
    elif strategy == "residual_corrected":
        out = rolled(F.col("t")) + F.when(place > 0, (1 - place) * (F.col("x_prev") - rolled(F.col("t_prev"))) + place * (F.col("x_next") - rolled(F.col("t_next")))).otherwise(F.col("x_prev") - rolled(F.col("t_prev")))
    else:
        backward = advance(F.col("x_next"), a, c, (F.col("t") - F.col("t_next")) / h)
        out = F.when(inside, (1 - place) * forward + place * backward).otherwise(forward)
    return b.select(*keys, "t", out.alias("x"))
