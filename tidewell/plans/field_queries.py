"""Fields in rows: spatial derivatives, feature libraries, principal modes. The table embeddings stands for periodic fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evolution as E
from ..operators import library as L
from ..operators import modes as M
from .inputs import table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Spectral differentiation of n samples on 2 pi is a product with a circulant matrix; entries by the distance d of two places.
FIELDS = """fl AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM embeddings), pt AS (SELECT vec_id, e, n, unnest(range(0, n)) AS j FROM fl),
dv AS (SELECT vec_id, j, e[j + 1] AS u, list_sum([CASE WHEN k = j THEN 0.0 ELSE 0.5 * (1 - 2 * ((j - k) % 2 != 0)::INT) / tan((j - k) * pi() / n) * e[k + 1] END FOR k IN range(0, n)]) AS ux,
list_sum([CASE WHEN k = j THEN -(n * n / 12.0 + 1 / 6.0) ELSE -0.5 * (1 - 2 * ((j - k) % 2 != 0)::INT) / pow(sin((j - k) * pi() / n), 2) END * e[k + 1] FOR k IN range(0, n)]) AS uxx FROM pt)"""


@query(f"WITH {FIELDS} SELECT vec_id, j::INT AS i, round(ux, 4) AS d FROM dv")
def k_spectral_derivative(spark, sf_dir):
    d = L.with_spectral_derivative(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 2 * np.pi, 1, "embedding")
    return d.select("vec_id", F.posexplode("derivative").alias("i", "d")).select("vec_id", "i", F.round("d", 4).alias("d"))


_TERMS = ", ".join(f"round({t}, 3)::DOUBLE AS f{i}" for i, t in enumerate(("1.0", "u", "u * u", "ux", "u * ux", "u * u * ux", "uxx", "u * uxx")))


@query(f"WITH {FIELDS} SELECT vec_id, j::INT AS j, {_TERMS} FROM dv")
def k_pde_library(spark, sf_dir):
    lib = L.pde_library(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 2 * np.pi, ["vec_id"], "embedding")
    return lib.select("vec_id", "j", *[F.round(f"f{i}", 3).alias(f"f{i}") for i in range(8)])


@query("""WITH m AS (SELECT vec_id, embedding AS e, len(embedding) AS n, least(10, len(embedding)) AS m FROM embeddings),
p AS (SELECT DISTINCT vec_id, e, round_even(i * (n - 1) / (m - 1)::DOUBLE, 0)::INT AS place FROM (SELECT *, unnest(range(0, m)) AS i FROM m))
SELECT vec_id, place, e[place + 1]::DOUBLE AS value FROM p""")
def lib_spatial_subset(spark, sf_dir):
    s = L.subset_state(table(spark, sf_dir, "embeddings"), ["vec_id"], 10, "embedding")
    return s.select("vec_id", "place", F.col("value").cast("double").alias("value"))


def _fields(spark, sf_dir):
    """All vectors as the fields of one run."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).alias("run"), F.col("embedding").cast("array<double>").alias("field"))


def _basis(f):
    return F.broadcast(M.basis(f, ["run"], rank=3))  # one row


@query()
def pod_project(spark, sf_dir):
    """Coordinates of all fields on the three leading modes; tests/test_modes.py compares modes with NumPy."""
    f = _fields(spark, sf_dir)
    z = M.project(f, _basis(f), ["run"])
    return z.select("vec_id", *[F.round(F.get("z", k), 6).alias(f"z{k}") for k in range(3)])


@query()
def pod_reconstruct(spark, sf_dir):
    """All fields from their coordinates on the three leading modes, with the error that is left."""
    f = _fields(spark, sf_dir)
    b = _basis(f)
    back = M.restore(M.project(f, b, ["run"]), b, ["run"], out="back")
    off = F.aggregate(F.zip_with("field", "back", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return back.select("vec_id", F.transform("back", lambda v: F.round(v, 6)).alias("field"), F.round(F.sqrt(off), 6).alias("error"))


@query("""WITH s AS (SELECT list(embedding ORDER BY vec_id) AS es FROM embeddings), e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT a.i::INT AS i, b.i::INT AS j, round(covar_pop(a.v, b.v), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def pod_covariance(spark, sf_dir):
    """All covariances of the components, from partial matrices."""
    x = _fields(spark, sf_dir).select("run", F.concat(F.array(F.lit(1.0)), "field").alias("x"))
    g = E.summed_products(x, ["run"], "x").select("g", F.col("n").alias("rows"), "width")
    n = F.col("width") - 1
    cells = g.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("*", F.explode(F.sequence(F.col("i"), n - 1)).alias("j"))
    at = lambda i, j: F.get("g", (i * (2 * F.col("width") - i - 1) / 2 + j).cast("int"))  # noqa: E731  cell (i, j) of the upper triangle
    zero = F.lit(0)
    cov = at(F.col("i") + 1, F.col("j") + 1) / F.col("rows") - at(zero, F.col("i") + 1) * at(zero, F.col("j") + 1) / F.col("rows") ** 2
    return cells.select("i", "j", F.round(cov, 6).alias("cov"))
