"""Principal modes of the fields of each run, the choice of their number, and the one-step map of their coordinates.

Fields are rows (keys, t, field array). Everything a run needs is in Gram matrices of its rows, summed in one pass
(``evolution.summed_products``); modes and maps are solves on those, a row for each run. For cross-validation the
matrices are summed by fold, and what a fold is trained on is the whole less what it holds: every rank of every fold
comes from the one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evolution as E
from . import library as L
from . import series as S


def energy_rank(values: np.ndarray, n: int, energy: float, most: int) -> int:
    """The least number of leading values with that share of their sum; at most most, all values, and n - 1; 1 without any."""
    values = np.clip(values, 0, None)
    if len(values) <= 1 or n <= 1 or values.sum() <= E.EPS:
        return 1
    share = np.cumsum(values) / values.sum()
    return int(max(1, min(np.searchsorted(share, energy, side="left") + 1, most, len(values), n - 1)))


def rank_rule(mode: str, fixed: int, named: dict[str, int] | None = None, name: Column | None = None, chosen: Column | None = None) -> Column:
    """The number of modes of a run: "fixed"; "named", by its name with fixed for all others; "chosen", a column (by energy
    or cross-validation) that falls back to the named rule where it is null."""
    if mode not in ("fixed", "named", "chosen"):
        raise ValueError(f"rank rule {mode} is none of fixed, named, chosen")
    rule = F.lit(int(fixed))
    if mode != "fixed" and named and name is not None:
        for n, rank in named.items():
            rule = F.when(name == n, int(rank)).otherwise(rule)
    return F.coalesce(chosen, rule) if mode == "chosen" else rule


def _centred(g: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance from products of [1, x]."""
    whole = np.zeros((width, width))
    whole[np.triu_indices(width)] = g
    whole = whole + np.triu(whole, 1).T
    n = whole[0, 0]
    mean = whole[0, 1:] / n
    return int(round(n)), mean, whole[1:, 1:] / n - np.outer(mean, mean)


def _modes(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and modes in columns, their largest entry positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), range(len(values))] < 0, -1.0, 1.0)


def basis(df: DataFrame, keys: list[str], rank: int | None = None, energy: float | None = None, most: int = 10, field: str = "field") -> DataFrame:
    """(keys, n, rank, mean, modes, energies) of each run: modes an array of rank arrays; energies all values of the centred
    products. Give a rank, or an energy share with at most most modes."""
    if (rank is None) == (energy is None):
        raise ValueError("give either rank or energy")
    products = E.summed_products(df.select(*keys, F.concat(F.array(F.lit(1.0)), F.col(field).cast("array<double>")).alias("__x")), keys, "__x")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                n, mean, cov = _centred(np.asarray(r["g"]), int(r["width"]))
                values, vectors = _modes(cov)
                k = energy_rank(values, n, energy, most) if rank is None else max(1, min(rank, len(values), n - 1))
                out.append((*[r[c] for c in keys], n, k, mean, [v.tolist() for v in vectors[:, :k].T], values * n))
            yield pd.DataFrame(out, columns=[*keys, "n", "rank", "mean", "modes", "energies"])

    return products.mapInPandas(run, E._kinds(df, keys) + "n long, rank int, mean array<double>, modes array<array<double>>, energies array<double>")


def project(df: DataFrame, bases: DataFrame, keys: list[str], field: str = "field", out: str = "z") -> DataFrame:
    """df with the coordinates of each field on its run's modes."""
    b = bases.select(*keys, F.col("mean").alias("__mean"), F.col("modes").alias("__modes"))
    centred = F.zip_with(F.col(field).cast("array<double>"), F.col("__mean"), lambda x, m: x - m)
    return df.join(b, keys).withColumn(out, F.transform(F.array(centred), lambda c: F.transform("__modes", lambda m: E._dot(c, m))).getItem(0)).drop("__mean", "__modes")


def restore(df: DataFrame, bases: DataFrame, keys: list[str], z: str = "z", out: str = "field") -> DataFrame:
    """df with the field of each row's coordinates."""
    b = bases.select(*keys, F.col("mean").alias("__mean"), F.col("modes").alias("__modes"))
    each = F.zip_with(F.col(z), F.col("__modes"), lambda c, m: F.transform(m, lambda v: c * v))
    return df.join(b, keys).withColumn(out, F.aggregate(each, F.col("__mean"), lambda s, m: F.zip_with(s, m, lambda a, b: a + b))).drop("__mean", "__modes")


def denoise(df: DataFrame, keys: list[str], rank: int | None = None, energy: float | None = None, most: int = 10, field: str = "field") -> DataFrame:
    """df with each field replaced by what its run's modes hold of it."""
    bases = basis(df, keys, rank, energy, most, field)
    return restore(project(df, bases, keys, field, "__z"), bases, keys, "__z", field).drop("__z")


def lifted_reconstruction(queries: DataFrame, fields: DataFrame, keys: list[str], rank: int, lift: str = "quadratic", centers: list[list[float]] | None = None, gamma: float = 1.0, strategy: str = "local_reset", field: str = "field", t: str = "t") -> DataFrame:
    """(keys, t, field) at the query times: fields on rank modes, their coordinates lifted (linear, quadratic, or radial functions around centers), carried
    by the lift's one-step operator, read out and restored. Every run must have more rows than modes."""
    bases = basis(fields, keys, rank, field=field)
    z = project(fields.select(*keys, F.col(t).alias("t"), F.col(field).alias("field")), bases, keys).drop("field")
    if lift == "radial":
        lifted = L.rbf_lift(z, centers or [], gamma, "z", "lifted")
    elif lift in ("linear", "quadratic"):
        lifted = E.polynomial_lift(z, rank, 1 if lift == "linear" else 2, "z")
    else:
        raise ValueError(f"lift {lift} is none of linear, quadratic, radial")
    lifted = lifted.select(*keys, "t", "lifted")
    forms = E.spectral_form(E.operators(E.lagged_products(lifted, keys, "lifted"), keys), keys, outputs=list(range(1, rank + 1)))
    found = E.reconstruct(queries, lifted, forms, keys, strategy, "lifted")
    return restore(found, bases, keys, "x").select(*keys, "t", "field")


# --- rank by cross-validation ------------------------------------------------------------------------


def rank_cv(df: DataFrame, keys: list[str], ranks: list[int], folds: int = 3, field: str = "field", t: str = "t", alpha: float = 1e-8) -> DataFrame:
    """(keys, rank, folds, score): how well the one-step map of that many modes predicts held-out fields, as the mean over the folds of
    the squared error over the training fields' variance; null if any fold has no score.

    Interior rows go round the folds. A fold is predicted from the training row before each held-out row, over the
    actual time, by modes and a map (coordinates and a constant) fitted without the fold: its map sees only training pairs one
    nominal lag apart, 2 at least, and it has no score with training rows for rank + 1 modes or fewer. All ranks of all folds
    come from the same matrices, summed by the folds of a row and of a pair."""
    rows = S.interior_folds(df.select(*keys, F.col(t).alias("t"), F.col(field).cast("array<double>").alias("x")), keys, folds)
    w = S.by_time(keys)
    rows = rows.withColumn("__x0", F.lag("x").over(w)).withColumn("__f0", F.lag("fold").over(w)).withColumn("__t0", F.lag("t").over(w))
    rows = rows.withColumn("__gap", F.col("t") - F.col("__t0")).withColumn("__h", F.percentile("__gap", 0.5).over(S.Window.partitionBy(*keys)))
    one = F.array(F.lit(1.0))
    single = rows.select(*keys, "__h", F.col("fold").alias("f0"), F.lit(-9).alias("f1"), F.concat(one, "x").alias("v"))
    usable = F.abs(F.col("__gap") - F.col("__h")) <= 1e-12 + 1e-7 * F.abs("__h")
    pair = rows.where(usable).select(*keys, "__h", F.col("__f0").alias("f0"), F.col("fold").alias("f1"), F.concat(one, "__x0", one, "x").alias("v"))
    group = [*keys, "__h", "f0", "f1"]
    sums = E.summed_products(single, group, "v").unionByName(E.summed_products(pair, group, "v"))
    sums = sums.groupBy(*keys, "__h").agg(F.collect_list(F.struct("f0", "f1", "n", "width", "g")).alias("sums"))  # (folds + 1)**2 matrices of a run at most

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                cells = r["sums"]
                held = sorted({int(c["f0"]) for c in cells if c["f1"] == -9 and c["f0"] >= 0})
                for k in held:
                    add = lambda some: sum(np.asarray(c["g"], float) for c in some)
                    alone = [c for c in cells if c["f1"] == -9 and c["f0"] != k]
                    pairs = [c for c in cells if c["f1"] != -9 and k not in (c["f0"], c["f1"])]
                    n, mean, cov = _centred(add(alone), int(alone[0]["width"]))
                    m = sum(int(c["n"]) for c in pairs)
                    values, vectors = _modes(cov)
                    for rank in ranks:
                        out.append((*[r[c] for c in keys], k, rank, len(held), *_fold_map(n, mean, vectors, cov, pairs, add, m, rank, alpha), r["__h"]))
            yield pd.DataFrame(out, columns=[*keys, "fold", "rank", "folds", "map", "bias", "basis", "mean", "spread", "__h"])

    kinds = E._kinds(df, keys) + "fold int, rank int, folds int, map array<double>, bias array<double>, basis array<array<double>>, mean array<double>, spread double, __h double"
    maps = sums.mapInPandas(fit, kinds)
    forms = maps.where("map IS NOT NULL").select(*keys, "fold", "rank", F.col("__h").alias("nominal"), F.lit(0).cast("long").alias("n"), (F.col("rank") + 1).alias("p"), F.col("map").alias("matrix"), F.lit("ok").alias("status"))
    forms = E.spectral_form(forms, [*keys, "fold", "rank"]).where("status = 'ok'").select(*keys, "fold", "rank", F.col("modes").alias("__modes"), "reads")
    known = maps.join(forms, [*keys, "fold", "rank"]).withColumnRenamed("__h", "__nominal")
    held = rows.where("fold >= 0").select(*keys, "fold", "t", "x", "__x0", "__t0")
    guess = held.join(known, [*keys, "fold"])
    z = F.transform(F.array(F.zip_with("__x0", "mean", lambda a, b: a - b)), lambda c: F.concat(one, F.transform("basis", lambda m: E._dot(c, m)))).getItem(0)
    guess = guess.withColumn("__z", E.evolve(z, F.col("__modes"), F.col("reads"), (F.col("t") - F.col("__t0")) / F.col("__nominal")))
    back = F.aggregate(F.zip_with(F.slice("__z", 2, F.size("basis")), "basis", lambda c, m: F.transform(m, lambda v: c * v)), F.col("mean"), lambda s, m: F.zip_with(s, m, lambda a, b: a + b))
    error = F.aggregate(F.zip_with("x", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("x")
    scores = guess.groupBy(*keys, "fold", "rank").agg((F.avg(error) / F.greatest(F.first("spread"), F.lit(E.EPS))).alias("mse"))
    scores = scores.where("NOT isnan(mse) AND abs(mse) < double('inf')")
    all_ranks = maps.select(*keys, "fold", "rank", "folds").join(scores, [*keys, "fold", "rank"], "left")
    return all_ranks.groupBy(*keys, "rank").agg(F.max("folds").alias("folds"), F.when(F.count("mse") == F.max("folds"), F.avg("mse")).alias("score"))


def _fold_map(n, mean, vectors, cov, pairs, add, m, rank, alpha):
    """map, bias, basis, mean and spread of one fold and rank; nulls where it can't be fitted."""
    none = (None, None, None, None, None)
    if n <= rank + 1 or m < 2 or rank > vectors.shape[1]:
        return none
    d, modes = len(mean), vectors[:, :rank]
    whole = np.zeros((2 * d + 2, 2 * d + 2))
    whole[np.triu_indices(2 * d + 2)] = add(pairs)
    whole = whole + np.triu(whole, 1).T
    turn = np.zeros((d + 1, rank + 1))  # [1, x] to [1, coordinates]
    turn[0, 0], turn[0, 1:], turn[1:, 1:] = 1.0, -mean @ modes, modes
    left, right = turn.T @ whole[: d + 1, : d + 1] @ turn, turn.T @ whole[: d + 1, d + 1 :] @ turn
    try:
        k = np.linalg.solve(left + alpha * np.eye(rank + 1), right)
    except np.linalg.LinAlgError:
        return none
    return (k.ravel(), mean @ modes, [v.tolist() for v in modes.T], mean, float(np.trace(cov) / d)) if np.isfinite(k).all() else none


def choose_rank(scores: DataFrame, keys: list[str], tol: float = 1e-12) -> DataFrame:
    """(keys, rank, score): the rank with the least score, the smaller one of two within tol; null where no rank has a score in all folds."""
    least = scores.groupBy(*keys).agg(F.min("score").alias("__least"))
    near = scores.join(least, keys).groupBy(*keys).agg(F.min(F.when(F.col("score") <= F.col("__least") + tol, F.struct("rank", "score"))).alias("b"))
    return near.select(*keys, F.col("b.rank").alias("rank"), F.col("b.score").alias("score"))
