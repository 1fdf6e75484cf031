"""One-step operators of vector series, and their fractional powers.

Observations stay rows. A series gives one Gram matrix, the summed products of each state with itself and with its
successor (``lagged_products``), in one pass; every operator is a small solve on that matrix, a row for each series
(``operators``). Its powers are kept in spectral form (``spectral_form``): eigenvalues and both sets of vectors as arrays
of a row, so that carrying a state over any part of a step is a row expression (``evolve``) in complex numbers, real only
when read out. What cannot be fitted is a row too, with a status that says why.

Matrices act on rows: the next state is x @ K.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series as S

FLOOR, EPS = 1e-12, 1e-12
#: Eigenvectors worse conditioned than this are those of a defective matrix; it is moved by this share of its norm, which makes
#: it diagonalisable and its powers wrong by about as much.
ILL_CONDITIONED, NUDGE = 1e7, 1e-11


# --- lifts ---------------------------------------------------------------------------------


def polynomial_lift(df: DataFrame, dims: int, degree: int = 2, state: str = "state", out: str = "lifted") -> DataFrame:
    """Adds the array of all products of up to degree entries of a state of dims numbers: 1, the entries, then the others in
    the order of combinations with replacement. The state's entries stand at 1 to dims."""
    x = [F.get(F.col(state), i).cast("double") for i in range(dims)]
    terms = [c for d in range(degree + 1) for c in combinations_with_replacement(range(dims), d)]
    return df.withColumn(out, F.array(*[reduce(lambda a, b: a * b, [x[i] for i in c]) if c else F.lit(1.0) for c in terms]))


def delay_states(df: DataFrame, keys: list[str], delays: int, t: str = "t", x: str = "x", out: str = "state") -> DataFrame:
    """(keys, t, state): each value with those after it as one state."""
    wide = S.delay_embedding(df, keys, delays, t, x)
    return wide.select(*keys, "t", F.array(*[F.col(f"x{d}").cast("double") for d in range(delays)]).alias(out))


# --- one pass of products ----------------------------------------------------------------------


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def summed_products(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, width, g): the summed products of each vector's entries, the upper triangle by rows. A batch gives a partial matrix
    of each series by one matrix product, and Spark adds up their cells. Vectors that are null or hold a null or NaN
    are left out; all of a series have one length."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, rows in part.groupby(keys, dropna=False, sort=False):
                a = np.stack(rows[vector].to_list()).astype(float)
                out.append((*key, len(a), a.shape[1], (a.T @ a)[np.triu_indices(a.shape[1])]))
            yield pd.DataFrame(out, columns=[*keys, "n", "width", "g"])

    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))
    partial = df.select(*keys, vector).where(F.coalesce(whole, F.lit(False))).mapInPandas(run, _kinds(df, keys) + "n long, width int, g array<double>")
    cells = partial.select(*keys, "n", "width", F.posexplode("g").alias("pos", "v"))
    sums = cells.groupBy(*keys, "width", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return sums.groupBy(*keys, "width").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("g"))


def lagged_products(df: DataFrame, keys: list[str], state: str = "state", t: str = "t", nominal_only: bool = True, rtol: float = 1e-7) -> DataFrame:
    """(keys, nominal, n, width, g): products of each state and its successor as one vector of width 2p, summed over the pairs with the
    nominal (median) lag of the series, or over all pairs of neighbours."""
    before = df.withColumn("__before", F.lag(state).over(S.by_time(keys, t)))
    p = S.nominal_pairs(before, keys, t, rtol=rtol)
    if nominal_only:
        p = p.where("usable")
    p = p.select(*keys, "nominal", F.concat("__before", state).alias("__pair"))
    return summed_products(p, [*keys, "nominal"], "__pair")


def hankel_products(df: DataFrame, keys: list[str], delays: int, state: str = "state", t: str = "t") -> DataFrame:
    """The same of states made of delays neighbours (delays, or half the series' rows if that is less, 2 at least), without making
    them: an entry of that matrix is the product sum of one lag but for a few products at the series' ends.

    A row for each lag is summed, and the first and last delays rows of each series are kept; the rest is assembled from
    these, so that a row of the series is read once and not copied delays times."""
    w = S.by_time(keys, t)
    rows = df.select(*keys, F.col(t).alias("t"), F.col(state).alias("x"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("m"))
    rows = rows.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("nominal", F.percentile("gap", 0.5).over(Window.partitionBy(*keys)))
    for k in range(1, delays + 1):
        rows = rows.withColumn(f"x{k}", F.lead("x", k).over(w))
    group = [*keys, "nominal", "m"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, some in part.groupby(group, dropna=False, sort=False):
                a, sums = np.stack(some["x"].to_list()).astype(float), []
                for k in range(delays + 1):
                    later = some["x"] if k == 0 else some[f"x{k}"]
                    there = later.notna().to_numpy()
                    b = np.stack(later[there].to_list()).astype(float) if there.any() else np.zeros((0, a.shape[1]))
                    sums.append(a[there].T @ b)
                out.append((*key, a.shape[1], np.concatenate([s.ravel() for s in sums])))
            yield pd.DataFrame(out, columns=[*group, "d", "g"])

    kinds = _kinds(df, keys) + "nominal double, m long, "
    lags = rows.select(*group, "x", *[f"x{k}" for k in range(1, delays + 1)]).mapInPandas(run, kinds + "d int, g array<double>")
    cells = lags.select(*group, "d", F.posexplode("g").alias("pos", "v")).groupBy(*group, "d", "pos").agg(F.sum("v").alias("v"))
    sums = cells.groupBy(*group, "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("g"))
    ends = rows.where((F.col("i") <= delays) | (F.col("i") > F.col("m") - delays)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("ends"))  # 2 delays rows of each series
    both = sums.join(ends.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])

    def assemble(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                m, d = int(r["m"]), int(r["d"])
                q = int(max(2, min(delays, m // 2)))
                g = np.asarray(r["g"]).reshape(delays + 1, d, d)
                x = {int(e["i"]) - 1: np.asarray(e["x"], float) for e in r["ends"]}
                pairs = m - q  # embedded states with a successor
                if pairs < 1:
                    continue
                whole = np.zeros(((q + 1) * d, (q + 1) * d))
                for j in range(q + 1):
                    for k in range(j, q + 1):  # sum over i below pairs of x[i + j] x[i + k]', all of lag k - j but both ends
                        lag = k - j
                        s = g[lag].copy()
                        for i in [*range(j), *range(pairs + j, m - lag)]:
                            s -= np.outer(x[i], x[i + lag])
                        whole[j * d : (j + 1) * d, k * d : (k + 1) * d] = s
                        whole[k * d : (k + 1) * d, j * d : (j + 1) * d] = s.T
                p = q * d  # the pair of a state and its successor
                take = np.r_[0:p, d : p + d]
                both = whole[np.ix_(take, take)]
                out.append((*[r[k] for k in keys], r["nominal"], 2 * p, pairs, both[np.triu_indices(2 * p)]))
            yield pd.DataFrame(out, columns=[*keys, "nominal", "width", "n", "g"])

    return both.mapInPandas(assemble, _kinds(df, keys) + "nominal double, width int, n long, g array<double>")


# --- operators from products ---------------------------------------------------------------------


def _blocks(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    whole = np.zeros((width, width))
    whole[np.triu_indices(width)] = g
    whole = whole + np.triu(whole, 1).T
    p = width // 2
    return whole, whole[:p, :p], whole[:p, p:], whole[p:, p:]


def _usual_rank(p: int, n: int) -> int:
    return max(1, min(10, p, n, min(p, n) - 1))


def _leading(a: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors of a symmetric matrix; values that are rounding alone are left out."""
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    some = values > len(a) * np.finfo(float).eps * max(values[0], 0.0)
    return values[some], vectors[:, some]


def _inverse(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a symmetric matrix of products."""
    values, vectors = _leading(a, len(a))
    return (vectors / values) @ vectors.T


def ridge(g: np.ndarray, width: int, n: int, alpha: float = 1e-8, rank: int | None = None) -> np.ndarray:
    """(U'U + alpha I)^-1 U'V."""
    _, uu, uv, _ = _blocks(g, width)
    return np.linalg.solve(uu + alpha * np.eye(len(uu)), uv)


def dmd(g: np.ndarray, width: int, n: int, alpha: float = 1e-8, rank: int | None = None) -> np.ndarray:
    """Least squares on the leading directions of the states."""
    _, uu, uv, _ = _blocks(g, width)
    values, vectors = _leading(uu, _usual_rank(len(uu), n) if rank is None else rank)
    s = np.sqrt(values)
    return (vectors / (s * (s + EPS))) @ vectors.T @ uv


def square_root(a: np.ndarray) -> np.ndarray:
    """The principal square root, by eigenvectors."""
    values, vectors = diagonalised(a)[:2]
    return (vectors * np.sqrt(values)) @ np.linalg.inv(vectors)


def forward_backward(g: np.ndarray, width: int, n: int, alpha: float = 1e-8, rank: int | None = None) -> np.ndarray:
    """The root of the forward operator times the inverse of the backward one."""
    _, uu, uv, vv = _blocks(g, width)
    ahead, back = _inverse(uu) @ uv, _inverse(vv) @ uv.T
    return np.real(square_root(np.linalg.pinv(back) @ ahead))


def total_least_squares(g: np.ndarray, width: int, n: int, alpha: float = 1e-8, rank: int | None = None) -> np.ndarray:
    """Least squares after both sides are projected on the leading right singular vectors of all states with their successors:
    of the joint products' leading eigenvectors, the lower half times the inverse of the upper one."""
    whole, uu, _, _ = _blocks(g, width)
    _, vectors = _leading(whole, _usual_rank(len(uu), n) if rank is None else rank)
    p = width // 2
    return (vectors[p:] @ np.linalg.pinv(vectors[:p])).T


METHODS: dict[str, Callable] = {"ridge": ridge, "dmd": dmd, "forward_backward": forward_backward, "total_least_squares": total_least_squares}


def operators(products: DataFrame, keys: list[str], method: str = "ridge", alpha: float = 1e-8, rank: int | None = None) -> DataFrame:
    """(keys, nominal, n, p, matrix, status): the one-step operator of each series, p x p by rows. A series that has none keeps its
    row, with null for the matrix and the reason as status."""
    fit = METHODS[method]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                matrix, status = None, "ok"
                try:
                    matrix = fit(np.asarray(r["g"], float), int(r["width"]), int(r["n"]), alpha, rank)
                    if not np.isfinite(matrix).all():
                        matrix, status = None, "fail: non-finite fitted matrix"
                except np.linalg.LinAlgError as e:
                    status = f"fail: {e}"
                out.append((*[r[k] for k in keys], r["nominal"], int(r["n"]), int(r["width"]) // 2, None if matrix is None else matrix.ravel(), status))
            yield pd.DataFrame(out, columns=[*keys, "nominal", "n", "p", "matrix", "status"])

    return products.select(*keys, "nominal", "n", "width", "g").mapInPandas(run, _kinds(products, keys) + "nominal double, n long, p int, matrix array<double>, status string")


# --- fractional powers -----------------------------------------------------------------------------


def diagonalised(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Eigenvalues, right vectors, how many values were raised to the floor, and whether the matrix had to be moved.

    Values within rounding of the real axis are put on it, so that a negative one has the phase pi; those below floor in size become floor."""
    a = np.asarray(a, complex)
    values, vectors = np.linalg.eig(a)
    moved = not np.linalg.cond(vectors) < ILL_CONDITIONED
    if moved:
        noise = np.random.default_rng(0).standard_normal(a.shape)
        values, vectors = np.linalg.eig(a + NUDGE * max(np.linalg.norm(a), EPS) / np.linalg.norm(noise) * noise)
    real = np.abs(values.imag) <= 100 * np.finfo(float).eps * np.maximum(1.0, np.abs(values))
    values = np.where(real, values.real + 0.0j, values)
    low = np.abs(values) < floor if floor is not None else np.zeros(len(values), bool)
    return np.where(low, complex(floor or 0.0), values), vectors, int(low.sum()), moved


FORM = "modes array<struct<growth: double, phase: double, right_re: array<double>, right_im: array<double>>>, reads array<struct<re: array<double>, im: array<double>>>, floored int, moved boolean"


def spectral_form(ops: DataFrame, keys: list[str], outputs: list[int] | None = None, floor: float = FLOOR, drop_phase: bool = False) -> DataFrame:
    """(keys, nominal, n, p, status, modes, reads, floored, moved): for each eigenvalue log |v|, its angle and its right vector; for each
    entry that is read out (outputs, or all) its column of the left vectors.

    drop_phase takes negative eigenvalues as positive: the real part of the matrix logarithm."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                head, p = (*[r[k] for k in keys], r["nominal"], int(r["n"]), int(r["p"])), int(r["p"])
                a = None if r["matrix"] is None else np.asarray(r["matrix"], float)
                if a is None or len(a) != p * p or not np.isfinite(a).all():
                    out.append((*head, r["status"] if r["status"] != "ok" else "fail: non-finite fitted matrix", None, None, None, None))
                    continue
                try:
                    values, right, floored, moved = diagonalised(a.reshape(p, p), floor)
                    left = np.linalg.inv(right)
                except np.linalg.LinAlgError as e:
                    out.append((*head, f"fail: {e}", None, None, None, None))
                    continue
                phase = np.angle(values)
                if drop_phase:
                    phase = np.where(values.imag == 0, 0.0, phase)
                modes = [{"growth": float(np.log(abs(v))), "phase": float(f), "right_re": right[:, j].real.tolist(), "right_im": right[:, j].imag.tolist()} for j, (v, f) in enumerate(zip(values, phase))]
                reads = [{"re": left[:, k].real.tolist(), "im": left[:, k].imag.tolist()} for k in (range(p) if outputs is None else outputs)]
                out.append((*head, "ok", modes, reads, floored, moved))
            yield pd.DataFrame(out, columns=[*keys, "nominal", "n", "p", "status", "modes", "reads", "floored", "moved"]).astype({"floored": "Int32", "moved": object})

    return ops.select(*keys, "nominal", "n", "p", "matrix", "status").mapInPandas(run, _kinds(ops, keys) + "nominal double, n long, p int, status string, " + FORM)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def evolve(x: Column, modes: Column, reads: Column, steps: Column) -> Column:
    """The real readout of state x after so many steps (parts of one, or negative), as an array."""
    f = F.round(steps, 12)  # equal parts of a step stay equal

    def turned(m, re, im):
        size, angle = F.exp(m["growth"] * f), m["phase"] * f
        return F.struct((size * (re * F.cos(angle) - im * F.sin(angle))).alias("re"), (size * (re * F.sin(angle) + im * F.cos(angle))).alias("im"))

    def mode(m, state):  # the coordinates are computed once, as is the state
        both = F.struct(_dot(state, m["right_re"]).alias("re"), _dot(state, m["right_im"]).alias("im"))
        return F.transform(F.array(both), lambda c: turned(m, c["re"], c["im"])).getItem(0)

    def read(d):
        return F.transform(reads, lambda r: _dot(F.transform(d, lambda z: z["re"]), r["re"]) - _dot(F.transform(d, lambda z: z["im"]), r["im"]))

    carried = F.transform(F.array(x), lambda state: F.transform(modes, lambda m: mode(m, state)))
    return F.transform(carried, read).getItem(0)


STRATEGIES = ("local_reset", "global_rollout", "residual_corrected", "two_sided")


def _blend(a: Column, b: Column, place: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: (1 - place) * u + place * v)


def reconstruct(queries: DataFrame, anchors: DataFrame, forms: DataFrame, keys: list[str], strategy: str = "local_reset", state: str = "state", t: str = "t") -> DataFrame:
    """(keys, t, x array): the readout at the query times within the observed window, from (keys, t, state) and the series' spectral
    forms. Series whose form failed give nothing here; their rows in forms say why.

    local_reset advances the anchor before (one that is later by rounding counts as at the time); global_rollout the first
    anchor; residual_corrected adds to the rollout the natural spline through what it misses at the anchors; two_sided blends the anchor before,
    advanced, with the anchor after, taken back, by the place between them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy} is none of {', '.join(STRATEGIES)}")
    good = forms.where("status = 'ok'").select(*keys, F.col("nominal").alias("__h"), "modes", "reads")
    modes, reads, h = F.col("modes"), F.col("reads"), F.col("__h")
    if strategy == "local_reset":
        last = anchors.groupBy(*keys).agg(F.max(t).alias("__end"))
        b = S.asof_anchor(queries, anchors, keys, t, state).join(last, keys).where(F.col("t") <= F.col("__end") + 1e-10).join(good, keys)
        return b.select(*keys, "t", evolve(F.col("x_prev"), modes, reads, F.greatest(F.lit(0.0), (F.col("t") - F.col("t_prev")) / h)).alias("x"))
    b = S.beside(queries, anchors, keys, t, state).where("t_prev IS NOT NULL AND (t_next IS NOT NULL OR t_prev = t)").join(good, keys)
    inside = F.col("t_next") > F.col("t_prev")
    place = F.when(inside, (F.col("t") - F.col("t_prev")) / F.when(inside, F.col("t_next") - F.col("t_prev"))).otherwise(0.0)
    if strategy == "two_sided":
        ahead = evolve(F.col("x_prev"), modes, reads, (F.col("t") - F.col("t_prev")) / h)
        back = evolve(F.col("x_next"), modes, reads, (F.col("t") - F.col("t_next")) / h)
        return b.select(*keys, "t", F.when(inside, _blend(ahead, back, place)).otherwise(ahead).alias("x"))
    first = anchors.groupBy(*keys).agg(F.min(F.struct(F.col(t).alias("t"), F.col(state).alias("x"))).alias("__first"))
    rolled = lambda time: evolve(F.col("__first.x"), modes, reads, (time - F.col("__first.t")) / h)
    if strategy == "global_rollout":
        return b.join(first, keys).select(*keys, "t", rolled(F.col("t")).alias("x"))
    exact = evolve(F.col("__s"), modes, reads, F.lit(0.0))  # what an anchor itself reads out
    missed = anchors.select(*keys, F.col(t).alias("t"), F.col(state).alias("__s")).join(good, keys).join(first, keys)
    missed = missed.select(*keys, "t", F.zip_with(exact, rolled(F.col("t")), lambda u, v: u - v).alias("x"))
    bent = natural_spline(queries.select(*keys, F.col(t).alias("t")), missed, keys).withColumnRenamed("x", "__bent").join(good, keys).join(first, keys)
    return bent.select(*keys, "t", F.zip_with(rolled(F.col("t")), "__bent", lambda u, v: u + v).alias("x"))


# --- natural splines, by overlapping stretches of anchors ------------------------------------------------

#: Anchors of a stretch, and how many more on both sides are solved with it: what lies beyond bends the curve by less than 2**-OVERLAP.
STRETCH, OVERLAP = 4096, 64


def natural_spline(queries: DataFrame, anchors: DataFrame, keys: list[str], t: str = "t", x: str = "x", stretch: int = STRETCH, overlap: int = OVERLAP) -> DataFrame:
    """(keys, t, x): the natural cubic spline through (keys, t, x array) at the query times between the first and last anchor.

    The second derivatives solve a tridiagonal system whose rows are dominated twice over by their diagonal, so an anchor's
    influence at least halves with every anchor it passes: stretches of anchors are solved apart, each with its neighbours'
    last overlap anchors, and no series is solved in one task. Two anchors give a line, one its value."""
    a = anchors.select(*keys, F.col(t).cast("double").alias("t"), F.col(x).alias("x")).withColumn("__i", F.row_number().over(S.by_time(keys, "t")) - 1)
    a = a.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    near = F.sequence(F.floor((F.col("__i") - overlap) / stretch), F.floor((F.col("__i") + overlap) / stretch))
    spread = a.withColumn("__stretch", F.explode(F.filter(near, lambda s: (s >= 0) & (s * stretch < F.col("__n")))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__i")
        time, value, i = part["t"].to_numpy(float), np.stack(part["x"].to_list()).astype(float), part["__i"].to_numpy()
        second = np.zeros_like(value)
        if len(time) > 2:
            h, slope = np.diff(time), np.diff(value, axis=0) / np.diff(time)[:, None]
            diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope, axis=0)
            for k in range(1, len(right)):  # elimination, then back substitution
                f = h[k] / diagonal[k - 1]
                diagonal[k] -= f * h[k]
                right[k] -= f * right[k - 1]
            second[-2] = right[-1] / diagonal[-1]
            for k in range(len(right) - 2, -1, -1):
                second[k + 1] = (right[k] - h[k + 1] * second[k + 2]) / diagonal[k]
        keep = i // stretch == int(part["__stretch"].iloc[0])
        return pd.DataFrame({**{k: part[k].to_numpy()[keep] for k in keys}, "t": time[keep], "x": list(value[keep]), "m": list(second[keep])})

    curve = spread.groupBy(*keys, "__stretch").applyInPandas(run, _kinds(anchors, keys) + "t double, x array<double>, m array<double>")
    bent = curve.select(*keys, "t", F.struct("x", "m").alias("s"))
    b = S.beside(queries, bent, keys, t, "s").where("t_prev IS NOT NULL AND (t_next IS NOT NULL OR t_prev = t)")
    h = F.col("t_next") - F.col("t_prev")
    left, right = (F.col("t_next") - F.col("t")) / h, (F.col("t") - F.col("t_prev")) / h
    ends = F.arrays_zip(F.col("x_prev.x").alias("a"), F.col("x_next.x").alias("b"), F.col("x_prev.m").alias("c"), F.col("x_next.m").alias("d"))
    between = F.transform(ends, lambda e: left * e["a"] + right * e["b"] + ((left * left * left - left) * e["c"] + (right * right * right - right) * e["d"]) * h * h / 6)
    return b.select(*keys, "t", F.when(h > 0, between).otherwise(F.col("x_prev.x")).alias("x"))
