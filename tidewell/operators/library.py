"""Feature libraries: products of columns, radial functions, spatial derivatives."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monomials(names: list[str], degree: int = 3) -> list[tuple[str, ...]]:
    """All products of total degree up to degree, the constant first, in the order of combinations with replacement."""
    return [c for d in range(degree + 1) for c in combinations_with_replacement(names, d)]


def feature_name(term: tuple[str, ...]) -> str:
    return "*".join(term) if term else "1"


def polynomial_library(df: DataFrame, columns: list[str], degree: int = 3, keep: list[str] = (), prefix: str = "f") -> DataFrame:
    """keep, and a column for each monomial, named prefix and its number."""
    def product(term):
        return reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in term], F.lit(1.0)) if term else F.lit(1.0)

    return df.select(*keep, *[product(term).alias(f"{prefix}{i}") for i, term in enumerate(monomials(columns, degree))])


def quadratic_library(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    return polynomial_library(df, columns, 2, keep, "z")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def rbf_gamma(centers: DataFrame, ident: str = "id", state: str = "state", eps: float = 1e-12, most: int = 1000, none_positive: str = "one") -> DataFrame:
    """(gamma): 1 / median of the positive squared distances between centers; of a single center 1 / variance of its
    numbers. Of several centers at one place it is 1, or with none_positive="variance" 1 / variance too.

    A model has few centers by definition; more than most of them are an error, so that the broadcast stays small."""
    n = centers.count()
    if n > most:
        raise ValueError(f"{n} centers; at most {most} are held by each task")
    a = centers.select(F.col(ident).alias("a"), F.col(state).cast("array<double>").alias("sa"))
    b = centers.select(F.col(ident).alias("b"), F.col(state).cast("array<double>").alias("sb"))
    d = a.join(F.broadcast(b), F.col("a") != F.col("b")).select(squared_distance(F.col("sa"), F.col("sb")).alias("d2"))
    d = d.where("d2 > 0").agg(F.percentile("d2", 0.5).alias("__median"))
    spread = a.select(F.explode("sa").alias("v")).agg((F.var_pop("v") + eps).alias("__spread"))
    other = F.lit(1.0) if n > 1 and none_positive == "one" else F.col("__spread")
    return d.join(F.broadcast(spread)).select((1.0 / F.greatest(F.coalesce("__median", other), F.lit(eps))).alias("gamma"))


def rbf_lift(df: DataFrame, centers: list[list[float]], gamma: float, state: str = "state", out: str = "lifted") -> DataFrame:
    """Adds the array [1, x, exp(-gamma |x - c|**2) for each center]."""
    x = F.col(state).cast("array<double>")
    radial = [F.exp(-F.lit(gamma) * squared_distance(x, F.array(*[F.lit(float(v)) for v in c]))) for c in centers]
    return df.withColumn(out, F.concat(F.array(F.lit(1.0)), x, F.array(*radial) if radial else F.array().cast("array<double>")))


def wavenumbers(n: int, length: float) -> np.ndarray:
    return 2 * np.pi * np.fft.fftfreq(n, d=length / n)


def spectral_derivative(u: np.ndarray, length: float, order: int) -> np.ndarray:
    """Derivative along the last axis of a periodic field."""
    return np.real(np.fft.ifft((1j * wavenumbers(u.shape[-1], length)) ** order * np.fft.fft(u, axis=-1), axis=-1))


def with_spectral_derivative(df: DataFrame, length: float, order: int, state: str = "state", out: str = "derivative") -> DataFrame:
    """Adds the spatial derivative of the periodic field in each row; rows of one batch are transformed together."""

    @F.pandas_udf("array<double>")
    def derive(u: pd.Series) -> pd.Series:
        by_size: dict[int, list[int]] = {}
        for i, row in enumerate(u):
            by_size.setdefault(-1 if row is None else len(row), []).append(i)
        out = [None] * len(u)
        for n, rows in by_size.items():
            if n > 0:
                d = spectral_derivative(np.stack([np.asarray(u.iloc[i], float) for i in rows]), length, order)
                for i, r in zip(rows, d):
                    out[i] = r
        return pd.Series(out)

    return df.withColumn(out, derive(F.col(state).cast("array<double>")))


PDE_TERMS = ("1", "u", "u*u", "u_x", "u*u_x", "u*u*u_x", "u_xx", "u*u_xx")


def pde_library(df: DataFrame, length: float, keys: list[str], state: str = "state") -> DataFrame:
    """(keys, j, f0 .. f7): the eight terms at each point j of each row's field."""
    d = with_spectral_derivative(with_spectral_derivative(df, length, 1, state, "__ux"), length, 2, state, "__uxx")
    z = d.select(*keys, F.posexplode(F.arrays_zip(F.col(state).cast("array<double>").alias("u"), F.col("__ux"), F.col("__uxx"))).alias("j", "z"))
    u, ux, uxx = F.col("z.u"), F.col("z.__ux"), F.col("z.__uxx")
    terms = (F.lit(1.0), u, u * u, ux, u * ux, u * u * ux, uxx, u * uxx)
    return z.select(*keys, "j", *[t.alias(f"f{i}") for i, t in enumerate(terms)])


def spatial_subset(n: int, most: int) -> list[int]:
    """Up to most of n places, evenly spread with both ends: round(i (n - 1) / (m - 1)), halves to the even one, each once."""
    m = max(1, min(most, n))
    if m >= n:
        return list(range(n))
    return sorted({round(i * (n - 1) / (m - 1)) for i in range(m)}) if m > 1 else [0]


def subset_state(df: DataFrame, keys: list[str], most: int, state: str = "state") -> DataFrame:
    """(keys, place, value): the evenly spread places of each row's field, whatever its size."""
    n = F.size(state)
    m = F.greatest(F.lit(1), F.least(F.lit(most), n))
    place = F.when(m >= n, F.sequence(F.lit(0), n - 1)).when(m == 1, F.array(F.lit(0)))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.bround(i * (n - 1) / F.greatest(m - 1, F.lit(1)), 0).cast("int")))
    return df.where(n > 0).select(*keys, F.col(state).alias("__s"), F.explode(place.otherwise(spread)).alias("place")).select(*keys, "place", F.get("__s", "place").alias("value"))
