"""Whitening of embeddings: principal components by a randomised range finder.

Vectors become rows of whole numbers, x = floor(SCALE * c) + SHIFT. A random test matrix of COMPONENTS + OVERSAMPLE columns is
carried through the covariance by passes over all centred rows: each pass sums (x - mean) ((x - mean)' Q) in the
tasks, dims x columns numbers each, which Spark adds up; the next basis is the orthonormal form of what comes back. After every pass
Rayleigh-Ritz gives values and vectors within the basis, and the residuals |V v - e v| say whether they are components to
double precision. If they are not after POWER_PASSES, as with flat spectra, the basis is expanded to the full
dimension, where one more pass makes Rayleigh-Ritz exact. Driver and tasks hold dims x dims numbers at most, whatever
the number of rows.

Defined results: vectors that are null, empty, hold null or non-finite entries, or entries of 2**40 and more in size, are dropped;
so are vectors of another length than the most common one (the longer of two as common); deviation is null where it
exceeds a long; components without variance (below SMALLEST of the whole) have no rows, so equal vectors give none; tied eigenvalues give
some basis of their space; rows alike stay; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS, OVERSAMPLE, POWER_PASSES = 8, 8, 3
SCALE, SHIFT = 1024, 100_000
#: Residuals up to this share of the largest value count as rounding.
ROUNDING, SMALLEST = 64 * np.finfo(float).eps, 1e-13


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that are left, x array<long>. Stored."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 40)))
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("c")).where(F.coalesce(good, F.lit(False)) & (F.size("c") > 0))
    rows = rows.select("id", F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    rows = stored(rows, "whiten-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "d")).alias("u")).select("u.d").first()[0]  # one number
    return rows.where(F.size("x") == (usual or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all rows of part(x), size numbers: one array a task, whose cells Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(_matrix(batch.column("x")))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # size rows
    out = np.zeros(size)
    for r in cells:
        out[r["cell"]] = r["v"]
    return out


def means(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sums S of every dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                high, low = (x >> 20).sum(0), (x & (1 << 20) - 1).sum(0)  # neither overflows
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(x.shape[1], len(x), np.int64))], ["cell", "high", "low", "n"])

    sums = rows.select("x").mapInArrow(run, "cell int, high long, low long, n long").groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
    found = sorted((r["cell"], (r["high"] << 20) + r["low"], r["n"]) for r in sums.collect())  # a row for each dimension
    return (found[0][2] if found else 0), [s for _, s, _ in found]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole and broken part of S / n, so that x - S / n is exact but for its last rounding."""
    whole = np.array([s // n for s in sums], np.int64)
    return whole, np.array([(s % n) / n for s in sums])


def _centred(x: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - centre[0]).astype(float) - centre[1]


def components(rows: DataFrame, n: int, sums: list[int], count: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = POWER_PASSES, seed: int = 7) -> dict:
    """values (falling), vectors [dims, found], trace, passes and whether the basis was expanded."""
    dims, centre = len(sums), _centre(n, sums)
    width = min(dims, count + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    done = 0
    while True:

        def part(x, q=basis):
            c = _centred(x, centre)
            return np.concatenate([(c.T @ (c @ q)).ravel(), [(c * c).sum()]])

        total = _summed(rows, part, dims * basis.shape[1] + 1) / n
        image, trace, done = total[:-1].reshape(dims, -1), total[-1], done + 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:count]
        values, turn = values[order], turn[:, order]
        vectors = basis @ turn
        residual = np.linalg.norm(image @ turn - vectors * values, axis=0)
        if basis.shape[1] == dims or (residual <= ROUNDING * max(values[0], 0.0)).all():
            break
        if done <= passes:
            basis = np.linalg.qr(image)[0]
        else:  # what is there, and the rest of the space
            basis = np.linalg.qr(np.concatenate([np.linalg.qr(image)[0], np.random.default_rng(seed + 1).standard_normal((dims, dims - width))], 1))[0]
    some = values > SMALLEST * trace
    return {"values": values[some], "vectors": vectors[:, some] / np.linalg.norm(vectors[:, some], axis=0), "trace": float(trace), "passes": done, "expanded": basis.shape[1] > width or width == dims, "residual": residual[some]}


def identity_error(rows: DataFrame, found: dict, n: int, sums: list[int]) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, from one more pass over the rows."""
    centre, out = _centre(n, sums), found["vectors"] / np.sqrt(found["values"])
    k = out.shape[1]

    def part(x):
        w = _centred(x, centre) @ out
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    total = _summed(rows, part, k * k + k) / n
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector that is left and each component."""
    rows = whole_vectors(vectors, id_col, vector_col)
    n, sums = means(rows)
    found = components(rows, n, sums, count) if n else None
    k = len(found["values"]) if n else 0
    error = identity_error(rows, found, n, sums) if k else 0.0
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    plan = (_centre(n, sums), np.array(sums, object), found["vectors"] / np.sqrt(found["values"]), found["values"] / found["trace"]) if k else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            centre, s, out, share = plan
            x = _matrix(batch.column("x"))
            w = _centred(x, centre) @ out
            size = n * float(np.abs(_centred(x, centre)).max() + 1)
            if len(sums) * size * size < 2.0**62:
                d = n * x - s.astype(np.int64)
                deviation = pa.array(np.repeat((d * d).sum(1), k))
            else:  # whole numbers of any length
                each = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
                deviation = pa.array([v if v < 1 << 63 else None for v in each for _ in range(k)], pa.int64())
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), k)))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation, pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
