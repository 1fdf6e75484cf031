"""Exact quantiles by counting against NumPy."""

import math

import numpy as np
import pytest

from tidewell.operators.quantiles import quantiles, with_quantiles
from pyspark.sql import functions as F


def groups():
    rng = np.random.default_rng(1)
    return {
        ("hot", 1): rng.normal(size=3001), ("hot", 2): np.exp(30 * rng.normal(size=400)) * rng.choice([-1, 1], 400), ("tied", 1): rng.integers(0, 3, 500).astype(float),
        ("close", 1): 1.0 + rng.integers(0, 40, 201) * 2.0**-52, ("edge", 1): np.array([2.0**k for k in range(-1074, 1024, 7)] + [0.0, -0.0]), ("one", 1): np.array([7.5]), ("two", None): np.array([-3.0, 8.0]),
        (None, 1): np.array([1.0, 2.0, 4.0]), ("far", 1): np.array([-math.inf, 1.0, math.inf, math.inf, 5.0]), ("huge", 1): np.array([-1.7e308, 1.7e308, 1.6e308, 1.5e308]),
    }


@pytest.mark.parametrize("q", [0.5, 0.95, 0.0, 1.0])
def test_quantiles_match_numpy(spark, q):
    data = groups()
    rows = [(a, b, float(v)) for (a, b), vs in data.items() for v in vs] + [("one", 1, None), ("one", 1, float("nan")), ("none", 1, None), ("none", 1, float("nan"))]
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(5)
    got = {(r.a, r.b): (r.mid, r.twice) for r in quantiles(df, ["a", "b"], {"mid": "x", "twice": F.col("x") / 2}, q).collect()}
    assert set(got) == {*data, ("none", 1)} and got["none", 1] == (None, None)
    for k, vs in data.items():
        s = np.sort(vs)
        at = (len(s) - 1) * q
        low, high = s[math.floor(at)], s[math.ceil(at)]
        want = low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))
        assert got[k][0] == pytest.approx(want, rel=1e-12, abs=0) and got[k][1] == pytest.approx(want / 2, rel=1e-12, abs=1e-323), k


def test_quantiles_beside_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, x double")
    got = {r.k: (r.n, r.mid) for r in with_quantiles(df, ["k"], [F.count("*").alias("n")], {"mid": "x"}).collect()}
    assert got == {"a": (2, 2.0), None: (1, 5.0), "b": (1, None)}
    assert with_quantiles(df, [], [F.count("*").alias("n")], {"mid": "x"}).collect()[0].asDict() == {"n": 4, "mid": 3.0}
    assert quantiles(df.limit(0), ["k"], {"mid": "x"}).count() == 0


def test_a_hot_group_is_not_gathered(spark):
    """A group of nearly all rows: no task orders more than a sliver of its values."""
    df = spark.range(200_000).select((F.col("id") % 50 == 0).cast("int").alias("k"), F.sin(F.col("id").cast("double")).alias("x"))
    out = quantiles(df, ["k"], {"mid": "x"})
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r.k: r.mid for r in out.collect()}
    x = np.sin(np.arange(200_000.0))
    k = np.arange(200_000) % 50 == 0
    assert got[0] == pytest.approx(np.median(x[~k]), abs=1e-12) and got[1] == pytest.approx(np.median(x[k]), abs=1e-12)
