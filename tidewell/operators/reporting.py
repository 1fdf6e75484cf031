"""Reports on experiment records: summaries, paired comparisons, clustered errors, pivots, best cases.

Metrics may hold NaN for failed records; every aggregate here takes NaN as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import clean, quantiles, with_quantiles


def finite(*columns: str) -> Column:
    """All of them are numbers."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return ok


def core_summary(df: DataFrame, keys: list[str], f1: str = "support_f1", error: str = "coef_error", score: str = "practical_score") -> DataFrame:
    each = [
        F.avg(clean(f1)).alias("mean_f1"), F.stddev_samp(clean(f1)).alias("std_f1"), F.avg(clean(error)).alias("mean_error"), F.avg(clean(score)).alias("mean_score"),
        F.count("*").alias("n"),
    ]
    return with_quantiles(df, keys, each, {"median_error": error})


def sensitivity_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and median of each metric, and the number of records."""
    each = [F.avg(clean(m)).alias(f"mean_{m}") for m in metrics]
    return with_quantiles(df, keys, [*each, F.count("*").alias("n")], {f"median_{m}": m for m in metrics})


def tuning_summary(df: DataFrame, keys: list[str], settings: list[str], error: str) -> DataFrame:
    """Medians of tuning settings, which records of other methods lack, and of the error; groups of a null key are left out."""
    known = df.dropna(subset=keys)
    return with_quantiles(known, keys, [F.count(clean(error)).alias("n")], {f"median_{c}": c for c in (*settings, error)})


def extended_summary(df: DataFrame, keys: list[str], metric: str, exact: str, seed: str) -> DataFrame:
    """mean, median, min, max, exact count and rate, number of seeds."""
    m = clean(metric)
    each = [
        F.avg(m).alias("mean"), F.min(m).alias("lowest"), F.max(m).alias("highest"), F.sum(F.col(exact).cast("int")).alias("exact_count"),
        F.avg(F.col(exact).cast("double")).alias("exact_rate"), F.countDistinct(seed).alias("n_seeds"), F.count("*").alias("n"),
    ]
    return with_quantiles(df, keys, each, {"median": metric})


def pivot_median(df: DataFrame, rows: list[str], column: str, values: list, metric: str) -> DataFrame:
    """Median of metric: a row for each value of rows, a column for each of the given values."""
    return quantiles(df, [*rows, column], {"__median": metric}).groupBy(*rows).pivot(column, values).agg(F.first("__median"))


def grouping_sets(df: DataFrame, sets: list[list[str]], metric: str) -> DataFrame:
    """Several groupings of one scan, one below the other; keys outside a grouping are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    m = clean(metric)
    own = [F.struct(F.lit(i).alias("__set"), *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys]) for i, s in enumerate(sets)]
    wide = df.select(m.alias("__m"), F.explode(F.array(*own)).alias("s")).select("__m", "s.*")
    each = [F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"), F.count("__m").alias("n"), F.max("__m").alias("highest")]
    return with_quantiles(wide, ["__set", *keys], each, {"median": "__m"}).drop("__set")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def complete_groups(df: DataFrame, keys: list[str], ok: Column, size: int) -> DataFrame:
    """Groups with exactly size rows, all of them ok."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(ok).alias("all_ok")).where((F.col("n") == size) & F.col("all_ok")).select(*keys, "n")


def _one_to_one(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    """df, that ends the query with an error if a key occurs twice in one method."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__twice", F.count(method).over(w) > F.size(F.collect_set(method).over(w)))
    twice = F.raise_error(F.lit("a key occurs twice in one method")).cast(df.schema[keys[0]].dataType)
    return df.withColumn(keys[0], F.when(F.col("__twice"), twice).otherwise(F.col(keys[0]))).drop("__twice")


def paired(df: DataFrame, keys: list[str], method: str, baseline, metrics: list[str], one_to_one: bool = True) -> DataFrame:
    """Every other method's records beside the baseline's with the same keys: method, metrics, and metric_base for each.

    With one_to_one, a key that occurs twice in the baseline or in one of the other methods ends the query with an error."""
    if one_to_one:
        df = _one_to_one(df, keys, method)
    base = df.where(F.col(method) == baseline).select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics])
    return df.where(F.col(method) != baseline).select(*keys, method, *metrics).join(base, keys)


def win_rates(pairs: DataFrame, groups: list[str], error: str = "coef_error", score: str = "practical_score") -> DataFrame:
    """Share of strictly better records, by error (lower) and by score (higher); a missing number is no win."""
    less = F.coalesce(clean(error) < clean(f"{error}_base"), F.lit(False))
    more = F.coalesce(clean(score) > clean(f"{score}_base"), F.lit(False))
    return pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(less.cast("double")).alias("error_win_rate"), F.avg(more.cast("double")).alias("score_win_rate"))


def paired_deltas(pairs: DataFrame, groups: list[str], seed: str, metric: str, tie: float = 1e-12) -> DataFrame:
    """Mean and median difference, wins and ties, and the standard error of the seeds' means with how many of those win."""
    d = pairs.withColumn("__d", clean(metric) - clean(f"{metric}_base"))
    each = [F.count("__d").alias("n"), F.avg("__d").alias("mean_delta"), F.sum((F.col("__d") > tie).cast("int")).alias("wins"), F.sum((F.abs("__d") <= tie).cast("int")).alias("ties")]
    whole = with_quantiles(d, groups, each, {"median_delta": "__d"})
    seeds = d.groupBy(*groups, seed).agg(F.avg("__d").alias("__m"))
    sem = seeds.groupBy(*groups).agg((F.stddev_samp("__m") / F.sqrt(F.count("__m"))).alias("seed_se"), F.sum((F.col("__m") > tie).cast("int")).alias("seed_mean_wins"))
    return whole.join(sem, groups)


def record_comparisons(df: DataFrame, keys: list[str], method: str, comparators: list, metrics: list[str]) -> DataFrame:
    """For each comparator: the other methods' records beside it. One scan and one join for all of them."""
    checked = _one_to_one(df, keys, method)
    base = checked.where(F.col(method).isin(comparators)).select(*keys, F.col(method).alias("comparator"), *[F.col(m).alias(f"{m}_base") for m in metrics])
    p = checked.select(*keys, method, *metrics).join(base, keys).where(F.col(method) != F.col("comparator"))
    return p.select(*keys, method, "comparator", *[(F.col(m) - F.col(f"{m}_base")).alias(f"{m}_delta") for m in metrics])


def seed_sem(df: DataFrame, groups: list[str], seed: str, metric: str) -> DataFrame:
    """Mean of the seeds' means and its standard error."""
    means = df.groupBy(*groups, seed).agg(F.avg(clean(metric)).alias("__m"))
    return means.groupBy(*groups).agg(F.avg("__m").alias("mean"), (F.stddev_samp("__m") / F.sqrt(F.count("__m"))).alias("sem"), F.count("__m").alias("n_seeds"))


def clustered_se(df: DataFrame, groups: list[str], cluster: str, metric: str) -> DataFrame:
    """Mean with its cluster-robust standard error: sqrt(g / (g - 1) * sum of squared cluster residual sums) / n. Two
    aggregations from the clusters' sums; null with fewer than two clusters."""
    m = clean(metric)
    sums = df.groupBy(*groups, cluster).agg(F.sum(m).alias("__s"), F.count(m).alias("__c"))
    w = Window.partitionBy(*groups)
    sums = sums.withColumn("__mean", F.sum("__s").over(w) / F.sum("__c").over(w)).withColumn("__r", F.col("__s") - F.col("__c") * F.col("__mean"))
    g = F.count("*")
    return sums.groupBy(*groups).agg(F.first("__mean").alias("mean"), F.when(g > 1, F.sqrt(g / (g - 1) * F.sum(F.col("__r") ** 2)) / F.sum("__c")).alias("clustered_se"), g.alias("clusters"), F.sum("__c").alias("n"))


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def delta_from_min(df: DataFrame, keys: list[str], x: str, out: str = "delta") -> DataFrame:
    return df.withColumn(out, F.col(x) - F.min(x).over(Window.partitionBy(*keys)))


def best_marks(df: DataFrame, keys: list[str], x: str, lower: bool = True, decimals: int = 3, out: str = "is_best") -> DataFrame:
    """Adds whether a row's rounded value is its group's best."""
    v, w = F.round(F.col(x), decimals), Window.partitionBy(*keys)
    return df.withColumn("__v", v).withColumn(out, F.col("__v") == (F.min("__v").over(w) if lower else F.max("__v").over(w))).drop("__v")


def mode_and_rate(df: DataFrame, keys: list[str], value: str, hit: Column) -> DataFrame:
    """The most frequent value (the least on ties) and the share of hits."""
    c = df.withColumn("__h", hit.cast("double")).groupBy(*keys, value).agg(F.count("*").alias("__c"), F.sum("__h").alias("__h"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("__c")).alias("o"), F.col(value).alias("v")))["v"].alias("mode"), (F.sum("__h") / F.sum("__c")).alias("rate"), F.sum("__c").alias("n"))


def bands(column: str, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first cut that the value does not exceed."""
    out = None
    for upto, label in cuts:
        out = F.when(F.col(column) <= upto, label) if out is None else out.when(F.col(column) <= upto, label)
    return out.otherwise(otherwise)


def ordered_by(df: DataFrame, column: str, values: list, out: str = "position", append: bool = False, met: str | None = None) -> DataFrame:
    """A row for each of the given values in their order, with nulls where df has none. With append, values outside the
    list follow, by the least of the column met (the order in which they were first met), or in their own order."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int") - 1
    order = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v).cast(df.schema[column].dataType) for v in values])).alias(out, column))
    found = order.join(df, column, "left")
    if not append:
        return found
    others = df.where(F.coalesce(position, F.lit(-1)) < 0)
    names = others.groupBy(column).agg(F.min(met or column).alias("__met"))  # a row for each value
    rank = F.dense_rank().over(Window.orderBy("__met", column)) + len(values) - 1
    names = names.withColumn(out, rank.cast("int")).select(column, out)
    return found.unionByName(others.join(names, column))


def labelled(df: DataFrame, column: str, labels: dict, out: str) -> DataFrame:
    """Adds the label of each value, or the value itself where there is none."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn(out, F.coalesce(m[F.col(column)], F.col(column).cast("string")))
