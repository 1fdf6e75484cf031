"""Series cut into stretches give what whole ones give, and no task takes a whole long series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import series as S


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, n in {"hot": 2000, "warm": 130, "short": 3, "one": 1}.items():
        t = np.round(np.concatenate([rng.uniform(0, 1, n // 2), rng.uniform(0, 500, n - n // 2)]), 6)  # half of it crowded
        rows += [(k, float(a), float(b), i % 7 == 0) for i, (a, b) in enumerate(zip(np.sort(t), rng.normal(size=n)))]
    rows += [(None, float(i), 1.0 * i * i, i == 3) for i in range(200)] + [("late", 5.0, 1.0, True)] * 2
    return spark.createDataFrame(rows, "k string, t double, x double, a boolean").repartition(6).cache()


def test_stretches_are_bounded_and_in_order(df):
    c = S.in_chunks(df, ["k"], rows=60).groupBy("k", "__chunk").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()
    hot = sorted((r.a, r.b, r.n) for r in c if r.k == "hot")
    assert len(hot) >= 15 and all(x[1] < y[0] for x, y in zip(hot, hot[1:]))  # crowded times may fill a cell
    assert {r["__chunk"] for r in c if r.k in ("short", "one", "late")} == {0} and max(r.n for r in c if r.k is None) <= 62


def test_neighbours_and_sums_match_windows(df, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 50)
    w = S.by_time(["k"])
    one = df.dropDuplicates(["k", "t"])
    want = one.select("k", "t", F.lag("x").over(w).alias("b"), F.lead("x").over(w).alias("n"), F.sum(F.col("a").cast("int")).over(w.rowsBetween(S.Window.unboundedPreceding, 0)).alias("s"))
    got = S.segment_id(S.with_neighbours(one, ["k"], ["x"]), ["k"], F.col("a")).select("k", "t", F.col("__before.x").alias("b"), F.col("__after.x").alias("n"), F.col("segment").alias("s"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    run = S.cumulative_energy(one, ["k"], "t").where("k = 'hot'").orderBy("t").toPandas()
    assert np.allclose(run["fraction"], np.cumsum(run["x"] ** 2) / (run["x"] ** 2).sum(), atol=1e-12)


def test_anchors_are_carried_over(df, monkeypatch):
    anchors, queries = df.where("a").dropDuplicates(["k", "t"]), df.select("k", (F.col("t") * 1.01 - 0.5).alias("t"))
    whole = S.beside(queries, anchors, ["k"], "t", "x", rows=10**9)
    for rows in (40, 7):
        cut = S.beside(queries, anchors, ["k"], "t", "x", rows=rows)
        assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0 and cut.count() == queries.count()
    monkeypatch.setattr(S, "CHUNK_ROWS", 30)
    a = anchors.where("k = 'hot'").orderBy("t").toPandas()
    got = S.linear_interp(queries.where("k = 'hot'"), anchors, ["k"]).toPandas()
    assert len(got) == 2000 and np.allclose(got["x"], np.interp(got["t"], a["t"], a["x"]), atol=1e-9)
