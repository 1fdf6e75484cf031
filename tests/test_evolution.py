"""One-step operators, their fractional powers and reconstructions against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import evolution as E

SERIES = {"a": 40, "b": 23}


def trajectory(seed, n, d=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 0.5
    t[-1] -= 0.2  # a short last gap
    a = np.linalg.qr(rng.normal(size=(d, d)))[0] * 0.97
    x = [rng.normal(size=d)]
    for _ in range(n - 1):
        x.append(x[-1] @ a + 0.05 * rng.normal(size=d))
    return t, np.array(x)


@pytest.fixture(scope="module")
def data():
    return {k: trajectory(i, n) for i, (k, n) in enumerate(SERIES.items())}


@pytest.fixture(scope="module")
def states(spark, data):
    rows = [(k, float(t), [float(v) for v in x]) for k, (ts, xs) in data.items() for t, x in zip(ts, xs)]
    return spark.createDataFrame(rows, "k string, t double, state array<double>").repartition(5).cache()


def lift(x):
    return np.array([1, *x, *[x[i] * x[j] for i in range(3) for j in range(i, 3)]])


def matrices(df):
    return {r.k: np.array(r.matrix).reshape(r.p, r.p) for r in df.collect()}


def test_lifted_operator_of_ten_terms(states, data):
    lifted = E.polynomial_lift(states, 3, 2)
    products = E.lagged_products(lifted, ["k"], "lifted")
    got = matrices(E.operators(products, ["k"]))
    for r in products.collect():
        assert r.n == SERIES[r.k] - 2 and r.width == 20 and r.nominal == 0.5
    for k, (t, x) in data.items():
        phi = np.array([lift(v) for v in x])
        u, v = phi[:-2], phi[1:-1]
        assert np.allclose(got[k], np.linalg.solve(u.T @ u + 1e-8 * np.eye(10), u.T @ v), atol=1e-7)


@pytest.mark.parametrize("method", ["dmd", "forward_backward", "total_least_squares"])
def test_operators_of_all_pairs(states, data, method):
    got = matrices(E.operators(E.lagged_products(states, ["k"], nominal_only=False), ["k"], method))
    for k, (_, x) in data.items():
        x1, x2 = x[:-1].T, x[1:].T
        if method == "dmd":
            u, s, v = np.linalg.svd(x1, full_matrices=False)
            want = x2 @ v[:2].T @ np.diag(1 / (s[:2] + 1e-12)) @ u[:, :2].T
        elif method == "total_least_squares":
            v = np.linalg.svd(np.vstack([x1, x2]), full_matrices=False)[2][:2].T
            want = x2 @ v @ v.T @ np.linalg.pinv(x1 @ v @ v.T)
        else:
            square = x2 @ np.linalg.pinv(x1) @ np.linalg.pinv(x1 @ np.linalg.pinv(x2))
            root = got[k].T
            assert np.allclose(root @ root, square, atol=1e-8) and (np.linalg.eigvals(root).real > -1e-9).all()
            continue
        assert np.allclose(got[k], want.T, atol=1e-8)


@pytest.mark.parametrize("delays", [2, 5, 30])
def test_hankel_products_need_no_embedding(states, data, delays):
    out = {r.k: r for r in E.hankel_products(states, ["k"], delays).collect()}
    for k, (_, x) in data.items():
        q = max(2, min(delays, len(x) // 2))
        h = np.array([x[i : i + q].ravel() for i in range(len(x) - q + 1)])
        pair = np.hstack([h[:-1], h[1:]])
        assert out[k].n == len(pair) and out[k].width == pair.shape[1] and out[k].nominal == 0.5
        assert np.allclose(out[k].g, (pair.T @ pair)[np.triu_indices(pair.shape[1])], atol=1e-9)


MATRICES = {"negative": [[-1.0]], "rotation": [[np.cos(0.6), -np.sin(0.6)], [np.sin(0.6), np.cos(0.6)]], "defective": [[1.0, 1.0], [0.0, 1.0]], "singular": [[0.0, 0.0], [0.0, 0.9]], "nan": [[float("nan")]]}


@pytest.fixture(scope="module")
def forms(spark):
    ops = spark.createDataFrame([(k, 0.5, 9, len(m), [float(v) for row in m for v in row], "ok") for k, m in MATRICES.items()] + [("failed", 0.5, 1, 2, None, "fail: singular")], "k string, nominal double, n long, p int, matrix array<double>, status string")
    return E.spectral_form(ops, ["k"]).cache()


def test_fractional_powers(spark, forms):
    info = {r.k: r for r in forms.collect()}
    assert info["nan"].status == "fail: non-finite fitted matrix" and info["nan"].modes is None and info["failed"].status == "fail: singular"
    assert info["singular"].floored == 1 and info["defective"].moved and not info["rotation"].moved
    want = {
        "negative": lambda f: np.cos(np.pi * f) * np.eye(1),
        "rotation": lambda f: np.array([[np.cos(0.6 * f), -np.sin(0.6 * f)], [np.sin(0.6 * f), np.cos(0.6 * f)]]),
        "defective": lambda f: np.array([[1.0, f], [0.0, 1.0]]),
        "singular": lambda f: np.diag([1e-12**f, 0.9**f]),
    }
    for k, power in want.items():
        p = len(MATRICES[k])
        units = spark.createDataFrame([(k, i, [float(i == j) for j in range(p)], f) for i in range(p) for f in (0.2, 0.5, 1.0, 3.0, 0.0)] + ([(k, 0, [1.0] + [0.0] * (p - 1), -1.5)] if k in ("rotation", "negative") else []), "k string, i int, x array<double>, f double")
        for r in units.join(forms, "k").select("i", "f", E.evolve(F.col("x"), F.col("modes"), F.col("reads"), F.col("f")).alias("y")).collect():
            assert np.allclose(r.y, power(r.f)[r.i], atol=1e-9), (k, r.f)


def powered(k, f):
    values, v = np.linalg.eig(k.astype(complex))
    values = np.where(abs(values) < 1e-12, 1e-12, values)
    return (v * np.exp(f * np.log(values))) @ np.linalg.inv(v)


def test_a_state_is_computed_once_however_many_modes(spark, forms):
    """An expression as state, such as coordinates on modes, must not be repeated for each eigenvalue and part."""
    units = spark.createDataFrame([("a", [1.0, 2.0])], "k string, x array<double>")
    state = F.transform("x", lambda v: v * 7.25)
    plan = units.join(forms, "k").select(E.evolve(state, F.col("modes"), F.col("reads"), F.lit(0.5)).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("7.25") == 1


@pytest.mark.parametrize("strategy", E.STRATEGIES)
def test_reconstructions_match_loops(spark, states, data, strategy):
    lifted = E.polynomial_lift(states, 3, 1)
    ops = E.operators(E.lagged_products(lifted, ["k"], "lifted"), ["k"])
    k_of, forms = matrices(ops), E.spectral_form(ops, ["k"], outputs=[1, 2, 3])
    times = {k: np.concatenate([np.arange(0, t[-1], 0.125), [t[-1]]]) for k, (t, _) in data.items()}
    queries = spark.createDataFrame([(k, float(v)) for k, ts in times.items() for v in ts] + [("a", 99.0)], "k string, t double")
    got = {(r.k, r.t): r.x for r in E.reconstruct(queries, lifted.drop("state"), forms, ["k"], strategy, "lifted").collect()}
    assert len(got) == sum(map(len, times.values()))
    for k, (t, x) in data.items():
        phi = np.hstack([np.ones((len(x), 1)), x])
        rolled = lambda s: np.real(phi[0] @ powered(k_of[k], (s - t[0]) / 0.5))[1:]
        missed = np.array([x[i] - rolled(s) for i, s in enumerate(t)])
        for s in times[k]:
            j = int(np.searchsorted(t, s, side="right") - 1)
            if strategy == "local_reset":
                want = np.real(phi[j] @ powered(k_of[k], (s - t[j]) / 0.5))[1:]
            elif strategy == "global_rollout":
                want = rolled(s)
            elif strategy == "two_sided":
                j = min(j, len(t) - 2)
                tau = (s - t[j]) / (t[j + 1] - t[j])
                want = (1 - tau) * np.real(phi[j] @ powered(k_of[k], (s - t[j]) / 0.5))[1:] + tau * np.real(phi[j + 1] @ powered(k_of[k], (s - t[j + 1]) / 0.5))[1:]
            else:
                want = rolled(s) + spline(t, missed, s)
            assert np.allclose(got[k, s], want, atol=1e-7), (k, s)


def spline(t, x, s):
    """The natural cubic spline by a dense solve."""
    n, h = len(t), np.diff(t)
    a, b = np.eye(n), np.zeros((n, x.shape[1]))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((x[i + 1] - x[i]) / h[i] - (x[i] - x[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    j = min(int(np.searchsorted(t, s, side="right") - 1), n - 2)
    u, v = (t[j + 1] - s) / h[j], (s - t[j]) / h[j]
    return u * x[j] + v * x[j + 1] + ((u**3 - u) * m[j] + (v**3 - v) * m[j + 1]) * h[j] ** 2 / 6


def test_splines_of_long_series_are_solved_in_stretches(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.01, 2.0, 300))
    x = rng.normal(size=(300, 2)).cumsum(0)
    anchors = spark.createDataFrame([(1, float(a), [float(v) for v in b]) for a, b in zip(t, x)] + [(2, 0.0, [1.0, 2.0]), (2, 2.0, [3.0, 2.0]), (3, 5.0, [7.0, 7.0])], "k int, t double, x array<double>").repartition(7)
    at = np.concatenate([t, rng.uniform(t[0], t[-1], 200)])
    queries = spark.createDataFrame([(1, float(s)) for s in at] + [(2, 1.0), (2, 2.5), (3, 5.0)], "k int, t double")
    got = E.natural_spline(queries, anchors, ["k"], stretch=40, overlap=50).collect()
    want = {float(s): spline(t, x, s) for s in at}
    assert {(r.k, r.t, *r.x) for r in got if r.k > 1} == {(2, 1.0, 2.0, 2.0), (3, 5.0, 7.0, 7.0)}
    ones = [r for r in got if r.k == 1]
    assert len(ones) == len(at) and all(np.allclose(r.x, want[r.t], atol=1e-9) for r in ones)


def test_failed_fits_keep_their_rows(spark):
    rows = [("flat", float(i), [0.0, 0.0]) for i in range(5)] + [("nan", float(i), [float("nan"), 1.0]) for i in range(5)] + [("short", 0.0, [1.0, 2.0])] + [("good", float(i), [0.5**i, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, t double, state array<double>")
    products = E.lagged_products(df, ["k"])
    out = {r.k: r for r in E.operators(products, ["k"], alpha=0.0).collect()}
    assert out["flat"].status.startswith("fail: ") and out["flat"].matrix is None and out["good"].status == "ok" and set(out) == {"flat", "good"}
    forms = {r.k: r.status for r in E.spectral_form(E.operators(products, ["k"], alpha=0.0), ["k"]).collect()}
    assert forms["flat"].startswith("fail: ") and forms["good"] == "ok"
    assert E.lagged_products(df.limit(0), ["k"]).count() == 0 and E.hankel_products(df.limit(0), ["k"], 3).count() == 0
