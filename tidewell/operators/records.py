"""Sets of experiment records: grids, resuming, replacing, common keys, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the given parameter values. Axes are short lists; the grid is exploded, not joined."""
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def combinations(*tables: DataFrame, most: int = 10_000) -> DataFrame:
    """All combinations of rows of parameter tables (a few values each). Tables after the first are held by each task, and more than most rows of one
    are an error."""
    for other in tables[1:]:
        if (n := other.limit(most + 1).count()) > most:
            raise ValueError(f"a parameter table has over {n - 1} rows; at most {most} are held by each task")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished record."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def replace_by_method(old: DataFrame, new: DataFrame, method: str = "method") -> DataFrame:
    """old without the methods that new has, and new; columns that one lacks are null."""
    kept = old.join(new.select(method).distinct(), method, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def common_keys(df: DataFrame, keys: list[str], variant: str, variants: list) -> DataFrame:
    """Records of the given variants whose keys occur in each of them."""
    some = df.where(F.col(variant).isin(variants))
    full = some.groupBy(*keys).agg(F.countDistinct(variant).alias("__v")).where(F.col("__v") == len(variants)).select(*keys)
    return some.join(full, keys, "left_semi")


def drift(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Records in both tables with the absolute differences of their metrics."""
    a = old.select(*keys, *[F.col(m).alias(f"{m}_old") for m in metrics])
    b = new.select(*keys, *[F.col(m).alias(f"{m}_new") for m in metrics])
    return a.join(b, keys).select(*keys, *[F.abs(F.col(f"{m}_new") - F.col(f"{m}_old")).alias(f"{m}_drift") for m in metrics])


def unknown_values(df: DataFrame, column: str, known: list) -> DataFrame:
    """Values outside the known ones; a caller that wants none asks whether this is empty."""
    return df.where(~F.col(column).isin(known)).select(column).distinct()


def record_seed(seed: Column, factor: Column, noise: Column) -> Column:
    """seed + 1000 factor + 100000 * (noise in thousandths, cut off)."""
    return (seed + 1000 * factor + 100000 * (noise * F.lit(1000.0)).cast("int")).cast("long")


def paired_seed(system_code: Column, is_pde: Column, factor: Column, noise: Column, seed: Column) -> Column:
    """One seed for all variants of a case: thousandths of noise are rounded here, and the field systems are set apart."""
    base = F.when(is_pde, 10_000_000).otherwise(0) + system_code * 1_000_000
    return F.pmod((base + seed + 1000 * factor + 100000 * F.round(noise * F.lit(1000.0)).cast("int")).cast("long"), F.lit(2**32 - 1))


def coefficients_to_json(df: DataFrame, keys: list[str], coef: str = "coef", order: str = "term") -> DataFrame:
    """(keys, coefficients): the coefficients of a model as a JSON list."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct(order, coef))), lambda s: s[coef])
    return df.groupBy(*keys).agg(F.to_json(packed).alias("coefficients"))


def coefficients_from_json(df: DataFrame, column: str = "coefficients") -> DataFrame:
    """A row for each coefficient of a JSON list: its columns, term and coef."""
    return df.select("*", F.posexplode(F.from_json(column, "array<double>")).alias("term", "coef"))


def active_coefficients(df: DataFrame, coef: str = "coef", truth: str = "true_coef", tol: float = 1e-12) -> DataFrame:
    return df.where((F.abs(coef) > tol) | (F.abs(truth) > tol))
