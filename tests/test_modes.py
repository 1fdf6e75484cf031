"""Modes of runs, rank rules and rank cross-validation against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import modes as M

D = 7


@pytest.fixture(scope="module")
def data():
    out = {}
    for k, (seed, n) in {"a": (1, 30), "b": (2, 19)}.items():
        rng = np.random.default_rng(seed)
        t = np.arange(n) * 2.0
        t[-1] -= 1.0
        wave = np.stack([np.cos(0.3 * t), np.sin(0.3 * t), 0.9 ** np.arange(n)], 1)
        out[k] = t, wave @ rng.normal(size=(3, D)) + 0.01 * rng.normal(size=(n, D)) + rng.normal(size=D)
    return out


@pytest.fixture(scope="module")
def fields(spark, data):
    rows = [(k, float(t), [float(v) for v in x]) for k, (ts, xs) in data.items() for t, x in zip(ts, xs)]
    return spark.createDataFrame(rows, "k string, t double, field array<double>").repartition(4).cache()


def test_basis_matches_svd(fields, data):
    for r in M.basis(fields, ["k"], rank=3).collect():
        x = data[r.k][1]
        _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        assert r.rank == 3 and np.allclose(r.mean, x.mean(0)) and np.allclose(np.array(r.energies), s**2, atol=1e-8)
        assert np.allclose(np.abs(np.array(r.modes) @ v[:3].T), np.eye(3), atol=1e-6)
    for energy, most in ((0.5, 10), (0.999, 10), (1.0, 2)):
        for r in M.basis(fields, ["k"], energy=energy, most=most).collect():
            x = data[r.k][1]
            e = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
            assert r.rank == max(1, min(int(np.searchsorted(np.cumsum(e) / e.sum(), energy) + 1), most, D, len(x) - 1))


def test_denoise_keeps_what_the_modes_hold(fields, data):
    got = {(r.k, r.t): np.array(r.field) for r in M.denoise(fields, ["k"], rank=2).collect()}
    for k, (t, x) in data.items():
        u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        want = (u[:, :2] * s[:2]) @ v[:2] + x.mean(0)
        assert np.allclose([got[k, s] for s in t], want, atol=1e-7)
    assert M.denoise(fields.limit(0), ["k"], rank=2).count() == 0


def evolved(left, right, row, f):
    k = np.linalg.solve(left.T @ left + 1e-8 * np.eye(left.shape[1]), left.T @ right)
    values, v = np.linalg.eig(k.astype(complex))
    values = np.where(abs(values) < 1e-12, 1e-12, values)
    return np.real(row @ (v * np.exp(f * np.log(values))) @ np.linalg.inv(v))


def modes_of(x, rank):
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:rank].T
    return x.mean(0), v


@pytest.mark.parametrize("lift", ["linear", "quadratic", "radial"])
def test_lifted_reconstruction_matches_loops(spark, fields, data, lift):
    rank = 2
    centers = [[0.5, -0.5], [0.0, 1.0]]
    features = {
        "linear": lambda z: [1, *z], "quadratic": lambda z: [1, *z, z[0] * z[0], z[0] * z[1], z[1] * z[1]],
        "radial": lambda z: [1, *z, *[np.exp(-0.3 * ((z - np.array(c)) ** 2).sum()) for c in centers]],
    }[lift]
    at = [0.0, 0.5, 2.0, 7.3, 35.0]
    queries = spark.createDataFrame([(k, s) for k in data for s in at], "k string, t double")
    got = {(r.k, r.t): r.field for r in M.lifted_reconstruction(queries, fields, ["k"], rank, lift, centers, 0.3).collect()}
    assert len(got) == 2 * len(at)
    signs = {r.k: np.array(r.modes).T for r in M.basis(fields, ["k"], rank=rank).collect()}
    for k, (t, x) in data.items():
        mean, v = x.mean(0), signs[k]
        phi = np.array([features(z) for z in (x - mean) @ v])
        for s in at:
            j = int(np.searchsorted(t, s, side="right") - 1)
            z = evolved(phi[:-2], phi[1:-1], phi[j], (s - t[j]) / 2.0)[1 : 1 + rank]
            assert np.allclose(got[k, s], mean + z @ v.T, atol=1e-5), (k, s)


def test_rank_cv_matches_loops(fields, data):
    ranks, folds = [1, 2, 3, 5, 7, 30], 3
    got = {(r.k, r["rank"]): r.score for r in M.rank_cv(fields, ["k"], ranks, folds).collect()}
    assert len(got) == 2 * len(ranks)
    for k, (t, x) in data.items():
        n = len(t)
        fold = np.array([-1, *[(i - 1) % folds for i in range(1, n - 1)], -1])
        for rank in ranks:
            scores = []
            for f in range(folds):
                keep = np.flatnonzero(fold != f)
                if len(keep) <= rank + 1 or rank > D:
                    continue
                mean, v = modes_of(x[keep], rank)
                phi = np.hstack([np.ones((len(keep), 1)), (x[keep] - mean) @ v])
                usable = np.isclose(np.diff(t[keep]), 2.0)
                guess = []
                for i in np.flatnonzero(fold == f):
                    j = int(np.searchsorted(t[keep], t[i], side="right") - 1)
                    guess.append(mean + evolved(phi[:-1][usable], phi[1:][usable], phi[j], (t[i] - t[keep][j]) / 2.0)[1:] @ v.T)
                scores.append(((x[fold == f] - np.array(guess)) ** 2).mean() / x[keep].var(0).mean())
            want = np.mean(scores) if len(scores) == folds else None
            assert (got[k, rank] is None) if want is None else abs(got[k, rank] - want) < 1e-5 * max(1, want), (k, rank, got[k, rank], want)
    best = {r.k: r["rank"] for r in M.choose_rank(M.rank_cv(fields, ["k"], ranks, folds), ["k"]).collect()}
    assert best == {k: min(ranks[:5], key=lambda r: (got[k, r], r)) for k in data}


def test_rank_rules(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("c", None)], "name string, best int")
    named = M.rank_rule("chosen", 8, {"b": 5}, F.col("name"), F.col("best"))
    assert [r.r for r in df.orderBy("name").select(named.alias("r")).collect()] == [3, 5, 8]
    assert [r.r for r in df.select(M.rank_rule("fixed", 4).alias("r")).collect()] == [4, 4, 4]
    tied = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5 + 1e-13), (1, 3, 0.6), (2, 1, None)], "k int, rank int, score double")
    assert {r.k: r["rank"] for r in M.choose_rank(tied, ["k"]).collect()} == {1: 1, 2: None}
