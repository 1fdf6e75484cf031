"""Operators against plain loops, analytic results and metamorphic rules."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell.operators import library, propagation, records, regression, reporting, selection, series
from tidewell.sources import files


def test_spectral_derivative():
    x = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    assert np.allclose(library.spectral_derivative(np.sin(x), 2 * np.pi, 1), np.cos(x), atol=1e-12)
    assert np.allclose(library.spectral_derivative(np.sin(3 * x), 2 * np.pi, 2), -9 * np.sin(3 * x), atol=1e-10)


def test_spatial_subset(spark):
    for n in (1, 2, 3, 7, 64):
        for most in (1, 2, 5, 10, 100):
            want = list(range(n)) if most >= n else sorted(set(np.round(np.linspace(0, n - 1, most)).astype(int).tolist()))
            assert library.spatial_subset(n, most) == want
            df = spark.createDataFrame([(1, [float(i) for i in range(n)])], "id int, state array<double>")
            got = library.subset_state(df, ["id"], most).orderBy("place").collect()
            assert [r.place for r in got] == want == [int(r.value) for r in got]


def test_rbf_width_falls_back(spark):
    def gamma(rows, **options):
        return library.rbf_gamma(spark.createDataFrame(rows, "id int, state array<double>"), **options).first().gamma

    assert gamma([(0, [1.0, 3.0])]) == pytest.approx(1 / (1.0 + 1e-12))
    assert gamma([(0, [1.0, 3.0]), (1, [1.0, 3.0])]) == 1.0
    assert gamma([(0, [1.0, 3.0]), (1, [1.0, 3.0])], none_positive="variance") == pytest.approx(1.0)
    assert gamma([(0, [0.0]), (1, [1.0]), (2, [3.0])]) == pytest.approx(1 / 4)
    with pytest.raises(ValueError):
        gamma([(i, [float(i)]) for i in range(5)], most=4)


def test_stlsq_gram_recovers_a_sparse_law():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 5))
    y = a @ np.array([[1.0], [0], [-2], [0.01], [0]]) + 0.001 * rng.normal(size=(200, 1))
    xi = regression.stlsq_gram(a.T @ a, a.T @ y, 0.1)
    assert np.allclose(xi[[0, 2], 0], [1, -2], atol=0.01) and not xi[[1, 3, 4]].any()


def test_gram_forms_agree(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), *[F.sin(F.col("id") * (i + 1)).alias(f"f{i}") for i in range(4)]).withColumn("y", 2 * F.col("f1") - F.col("f3"))
    names = [f"f{i}" for i in range(4)]
    paths = [regression.stlsq_path(g(df, names, ["y"], ["k"]), names, ["y"], [0.1], ["k"]).orderBy("k", "term").collect() for g in (regression.gram, regression.gram_arrays)]
    assert [(r.k, r.n) for r in paths[0]] == [(r.k, r.n) for r in paths[1]]
    assert np.allclose([r.coef for r in paths[0]], [r.coef for r in paths[1]]) and np.allclose([r.coef for r in paths[0]][:4], [0, 2, 0, -1], atol=1e-6)


def test_best_threshold_leaves_out_what_is_not_finite(spark):
    rows = [("a", 0, 0.1, 0, 1.0), ("a", 0, 0.1, 1, 0.2), ("a", 1, 0.2, 0, 1.0), ("a", 1, 0.2, 1, 0.0), ("a", 2, 0.3, 0, float("nan")), ("a", 2, 0.3, 1, 0.0), ("a", 3, 0.4, 0, 1.0), ("a", 3, 0.4, 1, 0.0)]
    path = spark.createDataFrame(rows, "k string, threshold_index int, threshold double, term int, coef double")
    truth = spark.createDataFrame([(0, 1.0), (1, 0.0)], "term int, true_coef double")
    got = regression.best_threshold(path, truth, ["k"]).collect()
    assert [(r.k, r.threshold, r.support_f1, r.coef_error, r.exact_support) for r in got] == [("a", 0.2, 1.0, 0.0, True)]


def test_folds_match_plain_loops(spark):
    rng = random.Random(1)
    for n in (6, 7, 23):
        t = np.cumsum([rng.uniform(0.1, 1) for _ in range(n)])
        x = np.array([rng.gauss(5, 2) for _ in range(n)])
        got = {r.fold: r.mse for r in series.fold_interp_mse(spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(t, x)], "k string, t double, x double"), ["k"], 4).collect()}
        folds = max(2, min(4, n - 2))
        own = np.array([-1] + [(i - 1) % folds for i in range(1, n - 1)] + [-1])
        for f in range(folds):
            held = own == f
            want = np.mean((np.interp(t[held], t[~held], x[~held]) - x[held]) ** 2) / max(x[~held].var(), 1e-12)
            assert got[f] == pytest.approx(want, rel=1e-9)
        assert len(got) == folds


def test_noise_falls_back_to_all_values(spark):
    rows = [("s", "flat", v) for v in (2.0, 2.0, 2.0)] + [("s", "one", 5.0)] + [("s", "wave", v) for v in (1.0, 3.0)]
    got = {r.c: r.sigma for r in series.noise_sigma(spark.createDataFrame(rows, "k string, c string, x double"), ["k"], "c").collect()}
    whole = 0.1 * np.std([2, 2, 2, 5, 1, 3])
    assert got == pytest.approx({"flat": whole, "one": whole, "wave": 0.1 * math.sqrt(2)})


def test_draws_are_normal_and_named(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 4).alias("c"), F.col("id").alias("i"), F.sin(F.col("id") / 7.0).alias("x")).repartition(3)
    draws = df.select("i", series.normal_draw(F.lit(7), "k", "i").alias("a"), series.normal_draw(F.lit(8), "k", "i").alias("b")).orderBy("i").toPandas()
    for v in (draws["a"], draws["b"]):
        assert abs(v.mean()) < 0.02 and abs(v.std() - 1) < 0.02 and abs((v**3).mean()) < 0.05 and abs((v**4).mean() - 3) < 0.15
    assert abs(np.corrcoef(draws["a"], draws["b"])[0, 1]) < 0.02 and abs(np.corrcoef(draws["a"][1:], draws["a"][:-1])[0, 1]) < 0.02
    noisy = lambda d: d.orderBy("i").select("i", F.round("noisy", 9).alias("noisy")).collect()
    one = series.add_noise(df, ["k"], "i", F.lit(3), 0.1, "c")
    assert noisy(one) == noisy(series.add_noise(df.repartition(11), ["k"], "i", F.lit(3), 0.1, "c")) != noisy(series.add_noise(df, ["k"], "i", F.lit(4), 0.1, "c"))
    spread = one.groupBy("c").agg((F.stddev(F.col("noisy") - F.col("x")) / F.stddev("x")).alias("r")).collect()
    assert all(abs(r.r - 0.1) < 0.005 for r in spread)
    assert [r.noisy for r in noisy(series.add_noise(df, ["k"], "i", F.lit(3), 0.0))] == [round(r.x, 9) for r in df.orderBy("i").collect()]
    null = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0)], "k string, i int, x double")
    assert series.add_noise(null, ["k"], "i", F.lit(1), 0.5).where("noisy IS NOT NULL").count() == 2


def test_weak_windows_are_exact_for_lines_between_samples(spark):
    t = np.array([-2, -1.6, -0.8, -0.45, 0.2, 0.7, 1.3, 2.0])
    x = np.cos(2 * t)
    got = series.weak_windows(spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(t, x)], "k string, t double, x double"), ["k"], 1.7, 0.25).orderBy("j").collect()
    assert [r.center for r in got] == pytest.approx([-0.3, -0.05, 0.2])
    fine = np.linspace(-2, 2, 400_001)
    f = np.interp(fine, t, x)
    for r in got:
        s = (fine - r.center) / 1.7
        inside = np.abs(s) < 1
        psi, slope = np.where(inside, (1 - s**2) ** 4, 0), np.where(inside, -8 * s * (1 - s**2) ** 3 / 1.7, 0)
        assert abs(r.integral - np.trapezoid(f * psi, fine)) < 1e-6 and abs(r.target + np.trapezoid(f * slope, fine)) < 1e-6


def test_weak_fields_match_fine_integrals(spark):
    """Windows in time and periodic space, one of them wrapping round, against sums over a fine grid of the bilinear interpolant."""
    rng, n, length = np.random.default_rng(5), 9, 3.0
    t = np.array([0, 0.4, 1.0, 1.3, 2.1, 2.6, 3.0])
    u = rng.normal(size=(len(t), n))
    df = spark.createDataFrame([("k", float(a), [float(v) for v in row]) for a, row in zip(t, u)] + [("k", 1.1, [1.0]), ("k", 1.2, None)], "k string, t double, field array<double>")
    centers, h, g = [0.2, 1.6], 1.1, 1.2
    got = series.weak_fields(df, ["k"], length, h, 0.5, centers, g).orderBy("j", "space").collect()
    assert [(r.center, r.space) for r in got] == [(pytest.approx(1.1), 0), (pytest.approx(1.1), 1), (pytest.approx(1.6), 0), (pytest.approx(1.6), 1)]
    p = np.polynomial.Polynomial([1.0, 0.0, -1.0]) ** 4

    def weights(grid, nodes, c, half, d):  # of each node's hat, by a fine sum
        fine = np.linspace(c - half, c + half, 40_001)
        test = (p.deriv(d) if d else p)((fine - c) / half) / half**d
        return np.array([np.trapezoid(np.interp(fine, grid, e) * test, fine) for e in nodes])

    wide = np.concatenate([np.arange(-n, 2 * n + 1) * length / n])
    hats = [np.tile(np.eye(n)[j], 4)[: len(wide)] for j in range(n)]
    for r in got:
        wt = [weights(t, np.eye(len(t)), r.center, h, d) for d in (0, 1)]
        wx = [weights(wide, hats, centers[r.space], g, d) for d in (0, 1, 2)]
        norm = (256 / 315) ** 2 * h * g
        want = [1.0, wt[0] @ u @ wx[0] / norm, wt[0] @ u**2 @ wx[0] / norm, -wt[0] @ u @ wx[1] / norm, -wt[0] @ u**2 @ wx[1] / norm / 2, -wt[0] @ u**3 @ wx[1] / norm / 3, wt[0] @ u @ wx[2] / norm, wt[0] @ u**2 @ wx[2] / norm]
        assert np.allclose([r[f"f{i}"] for i in range(8)], want, atol=1e-5) and abs(r.target + wt[1] @ u @ wx[0] / norm) < 1e-5
    with pytest.raises(ValueError):
        series.periodic_weights(8, 2.0, [0.0], 1.5)


def test_propagation_of_an_exact_map(spark):
    """Strategies agree with the map's own powers, for growth, decay, alternation and drift; gaps that are odd fit no pairs."""
    for a, b in ((0.8, 0.5), (1.1, -0.2), (1.0, 0.3), (-0.7, 0.4)):
        x = [1.0]
        for _ in range(9):
            x.append(a * x[-1] + b)
        rows = [("k", float(i), v) for i, v in enumerate(x)]
        anchors = spark.createDataFrame([*rows, ("k", 9.3, 50.0)], "k string, t double, x double")
        m = propagation.one_step_map(anchors, ["k"]).first()
        assert (m.a, m.b) == pytest.approx((a, b), abs=1e-6) and (m.nominal, m.n) == (1.0, 9)
        times = [0.0, 0.25, 3.5, 4.0, 8.75]
        q = spark.createDataFrame([("k", t) for t in times], "k string, t double")

        def power(f):
            return abs(a) ** f * (math.cos(math.pi * f) if a < 0 else 1)

        def at(v, f):
            return power(f) * v + (b * f if a == 1 else b * (1 - power(f)) / (1 - a))

        for strategy in propagation.STRATEGIES:
            got = [r.x for r in propagation.propagate(q, anchors, ["k"], strategy).orderBy("t").collect()]
            for t, v in zip(times, got):
                i, f = int(t), t - int(t)
                reset, rolled = at(x[i], f), at(x[0], t)
                want = {"local_reset": reset, "global_rollout": rolled, "two_sided": (1 - f) * reset + f * at(x[i + 1], f - 1)}.get(strategy)
                if strategy == "residual_corrected":
                    want = rolled + (1 - f) * (x[i] - at(x[0], i)) + f * (x[i + 1] - at(x[0], i + 1))
                assert v == pytest.approx(want, abs=2e-5), (a, strategy, t)
    with pytest.raises(ValueError):
        propagation.propagate(q, anchors, ["k"], "none")


def test_chord_and_knee(spark):
    def choose(points):
        front = spark.createDataFrame([("g", s, e, s) for s, e in points], "g string, support_size int, ebic double, candidate_id int")
        return tuple(selection.chord_elbow(front, ["g"]).select("support_size", "selection_rule").first()), selection.select_models(front, ["g"]).select("support_size", "selection_rule").first()

    assert choose([(1, 5.0)])[0] == (1, "single")
    assert choose([(1, 5.0), (2, 1.0)])[0] == (2, "fallback_min_ebic")
    assert choose([(1, 4.0), (2, 4.0), (3, 4.0)])[0] == (1, "fallback_min_ebic")
    assert choose([(1, 9.0), (2, 6.0), (3, 3.0)])[0] == (3, "fallback_min_ebic")
    assert choose([(1, 100.0), (2, 10.0), (3, 9.0), (4, 8.0)])[0] == (2, "elbow_ebic")
    assert choose([(1, 100.0), (2, 99.0), (3, 98.0), (4, 10.0)])[0] == (3, "elbow_ebic")  # below the chord counts too


def kneedle(x, y, sensitivity):
    """The published algorithm as a loop over a sorted curve."""
    if len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    d = (y - y.min()) / np.ptp(y) - (x - x.min()) / np.ptp(x)
    peaks = [i for i in range(1, len(d) - 1) if d[i] >= d[i - 1] and d[i] >= d[i + 1]]
    for i, end in zip(peaks, [*peaks[1:], len(d)]):
        if any(d[j] < d[i] - sensitivity / (len(x) - 1) for j in range(i + 1, end)):
            return x[i]
    return None


@pytest.mark.parametrize("sensitivity", [1.0, 0.3, 4.0])
def test_knees_match_the_loop(spark, sensitivity):
    rng = random.Random(8)
    fronts = {g: [(s, round(rng.choice([100 / s, 100 - s * s, 50.0]) + rng.random() * rng.choice([0, 1, 20]), 3)) for s in sorted(rng.sample(range(1, 15), rng.randrange(1, 12)))] for g in range(60)}
    df = spark.createDataFrame([(g, s, e, s) for g, f in fronts.items() for s, e in f], "g int, support_size int, ebic double, candidate_id int")
    got = {r.g: r for r in selection.select_models(df, ["g"], sensitivity=sensitivity).collect()}
    plain = {r.g: r for r in selection.chord_elbow(selection.pareto_front(df, ["g"]), ["g"]).collect()}
    found = 0
    for g, f in fronts.items():
        x, y = np.array([s for s, _ in f], float), np.array([e for _, e in f])
        knee = kneedle(x, y.max() - y, sensitivity)
        found += knee is not None
        assert (got[g].support_size, got[g].selection_rule) == ((knee, "elbow_ebic") if knee is not None else (plain[g].support_size, plain[g].selection_rule)), f
    assert len(got) == 60 and found > 0


def test_oracle_fits_match_loops(spark):
    """The best threshold of eight-term fits and both residuals, group by group; a group without a fit keeps its row."""
    rng, names, steps = np.random.default_rng(6), [f"f{i}" for i in range(8)], [0.0, 0.1, 0.5, 1.5]
    law = {"f1": -1.0, "f6": 0.7}
    rows = {k: rng.normal(size=(80, 8)) * [1, 2, 0.5, 1, 1, 3, 1, 0.1] for k in ("a", "b")}
    ys = {k: a @ np.array([0, -1, 0, 0, 0, 0, 0.7, 0]) + (0.3 if k == "b" else 0.01) * rng.normal(size=80) for k, a in rows.items()}
    table = [(k, *map(float, r), float(y)) for k in rows for r, y in zip(rows[k], ys[k])] + [("lost", *[float("nan")] * 8, 1.0)]
    df = spark.createDataFrame(table, "k string, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(3)
    got = {r.k: r for r in regression.oracle_fit(df, names, "y", law, steps, ["k"]).collect()}
    assert set(got) == {"a", "b", "lost"} and got["lost"].status.startswith("fail: ") and got["lost"].threshold is None and got["lost"].truth_residual is None
    truth = np.array([law.get(n, 0.0) for n in names])
    for k, a in rows.items():
        y, best = ys[k], None
        norms = np.linalg.norm(a, axis=0)
        for h in steps:
            on, x = np.ones(8, bool), np.zeros(8)
            for _ in range(13):
                x = np.zeros(8)
                s = a[:, on] / norms[on]
                x[on] = np.linalg.solve(s.T @ s + 1e-8 * np.eye(on.sum()), s.T @ y) / norms[on]
                on = on & (np.abs(x) >= h)
            hit, want = np.abs(x) > 1e-10, np.abs(truth) > 1e-10
            f1, err = 2 * (hit & want).sum() / (hit.sum() + want.sum()), np.linalg.norm(x - truth) / np.linalg.norm(truth)
            if best is None or (f1 / (1 + err), f1, -err) > best[0]:
                best = (f1 / (1 + err), f1, -err), h, np.linalg.norm(y - a @ x) / np.linalg.norm(y)
        r = got[k]
        assert r.status == "ok" and r.n == 80 and r.threshold == best[1] and np.allclose([r.practical_score, r.support_f1, -r.coef_error], best[0], atol=1e-6)
        assert abs(r.fit_residual - best[2]) < 1e-6 and abs(r.truth_residual - np.linalg.norm(y - a @ truth) / np.linalg.norm(y)) < 1e-6


def test_failed_fits_are_rows(spark):
    df = spark.createDataFrame([("flat", 0.0, 0.0, 1.0), ("nan", float("nan"), 1.0, 1.0), ("good", 1.0, 0.0, 2.0), ("good", 0.0, 1.0, 3.0)], "k string, a double, b double, y double")
    path = regression.stlsq_path(regression.gram(df, ["a", "b"], ["y"], ["k"]), ["a", "b"], ["y"], [0.1, 9.0], ["k"], alpha=0.0)
    rows = path.collect()
    assert len(rows) == 3 * 2 * 2 and {(r.k, r.status == "ok") for r in rows} == {("flat", False), ("nan", False), ("good", True)}
    assert all((r.coef is None) == (r.rss is None) == (r.status != "ok") for r in rows)
    lost = regression.failures(path, ["k"]).collect()
    assert sorted((r.k, r.threshold_index) for r in lost) == [("flat", 0), ("flat", 1), ("nan", 0), ("nan", 1)] and all(r.status.startswith("fail: ") for r in lost)
    assert {r.k for r in selection.candidate_path(path, ["k"]).collect()} == {"good"}


def test_selection_does_not_see_the_truth(spark):
    """Poisoned truth columns change no choice."""
    rng = random.Random(4)
    rows = [("g", s, 100 / s + rng.random(), s, rng.random(), rng.random()) for s in range(1, 9) for _ in range(3)]
    df = spark.createDataFrame([(*r[:3], i, *r[4:]) for i, r in enumerate(rows)], "g string, support_size int, ebic double, candidate_id int, support_f1 double, coef_error double")
    poisoned = df.withColumn("support_f1", F.lit(float("nan"))).withColumn("coef_error", F.rand(1) * 1e9)
    chosen = [selection.select_models(d, ["g"]).select("candidate_id", "selection_rule").collect() for d in (df, poisoned)]
    assert chosen[0] == chosen[1]


def test_pairs_are_validated_on_both_sides(spark):
    rows = [(1, "N", 1.0), (1, "A", 2.0), (2, "N", 1.0), (2, "R", 3.0)]
    schema = "k int, method string, e double"
    assert reporting.paired(spark.createDataFrame(rows, schema), ["k"], "method", "N", ["e"]).count() == 2
    for extra in ((1, "N", 5.0), (1, "A", 5.0)):
        df = spark.createDataFrame([*rows, extra], schema)
        with pytest.raises(PySparkException):
            reporting.paired(df, ["k"], "method", "N", ["e"]).collect()
        assert reporting.paired(df, ["k"], "method", "N", ["e"], one_to_one=False).count() == 3


def test_ordered_methods(spark):
    df = spark.createDataFrame([("b", 1), ("z", 2), ("a", 3)], "m string, v int")
    assert [tuple(r) for r in reporting.ordered_by(df, "m", ["z", "q"]).orderBy("position").collect()] == [("z", 0, 2), ("q", 1, None)]
    assert [tuple(r) for r in reporting.ordered_by(df, "m", ["z", "q"], append=True).orderBy("position").collect()] == [("z", 0, 2), ("q", 1, None), ("a", 2, 3), ("b", 3, 1)]
    assert [tuple(r) for r in reporting.ordered_by(df, "m", ["z", "q"], append=True, met="v").orderBy("position").collect()] == [("z", 0, 2), ("q", 1, None), ("b", 2, 1), ("a", 3, 3)]


def test_reports_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"m{i % 3}", i % 5, rng.random() if i % 7 else float("nan")) for i in range(200)], "m string, seed int, e double")
    a, b = (reporting.clustered_se(d, ["m"], "seed", "e").orderBy("m").toPandas() for d in (df.repartition(1), df.repartition(7)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    want = df.toPandas().dropna().groupby("m")["e"].mean()
    assert np.allclose(a["mean"], want)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, float("nan"))], "system string, seed int, noise double")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert back.count() == 2 and back.where("method IS NULL").count() == 2
    assert sorted((r.system, r.seed) for r in back.collect()) == [("a", 1), ("b", 2)] and math.isnan(back.where("seed = 2").first().noise)
    assert files.archive(df, str(tmp_path / "p")) and not files.archive(df, str(tmp_path / "p"))
    files.append(df, str(tmp_path / "a"))
    files.append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert files.table_hash(df) == files.table_hash(df.repartition(3)) and "content" in files.manifest(df)
    assert files.to_markdown(df).count("\n") == 3
    files.write_manifest(df, str(tmp_path / "m"), study="x")
    assert files.read_manifest(spark, str(tmp_path / "m"))["study"] == "x"


def test_bad_cells_batches_and_digests(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([("a", "1", "x"), ("b", "", "0.5"), ("c", "2.7e", "nan"), ("d", "zz", "")], "system string, seed string, noise string").coalesce(1).write.option("header", True).csv(path)
    back = files.read_csv(spark, path, bad="bad")
    assert {r.system: (r.seed, r.bad) for r in back.collect()} == {"a": (1, ["noise=x"]), "b": (None, []), "c": (None, ["seed=2.7e"]), "d": (None, ["seed=zz"])}
    assert {tuple(r) for r in files.bad_cells(back, "bad").collect()} == {("noise", 1, "x"), ("seed", 2, "2.7e")}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "system string, seed int")
    for batch, rows in (("one", df), ("two", df), ("one", df), ("one", df.limit(1))):  # a batch that is written again
        files.append_batch(rows, str(tmp_path / "b"), batch)
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "b")).collect()) == ["one", "two", "two"]
    top = tmp_path / "files"
    (top / "deep").mkdir(parents=True)
    content = {"one.txt": b"abc", "deep/two.bin": bytes(range(256)), "three.txt": b"3"}
    for name, data in content.items():
        (top / name).write_bytes(data)
    before = files.file_digests(spark, str(top)).cache()
    assert {r.path.split("/files/")[1]: (r.bytes, r.sha256) for r in before.collect()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}
    assert files.changed_files(before, files.file_digests(spark, str(top))).count() == 0
    (top / "one.txt").write_bytes(b"abd")
    (top / "three.txt").unlink()
    (top / "four.txt").write_bytes(b"4")
    change = {r.path.split("/files/")[1]: r.change for r in files.changed_files(before, files.file_digests(spark, str(top))).collect()}
    assert change == {"one.txt": "changed", "three.txt": "missing", "four.txt": "new"}
    assert files.file_digests(spark, str(top), "*.bin").count() == 1


def test_combinations_are_of_short_tables(spark):
    a, b = spark.range(3).withColumnRenamed("id", "a"), spark.range(4).withColumnRenamed("id", "b")
    assert records.combinations(a, b).count() == 12
    with pytest.raises(ValueError):
        records.combinations(a, b, most=3)


def test_failed_tasks_are_done_again_once(spark):
    tasks = records.parameter_grid(spark, system=["a", "b"], seed=[1, 2])
    done = spark.createDataFrame([("a", 1)], "system string, seed int")
    assert sorted(map(tuple, records.remaining(tasks, done, ["system", "seed"]).collect())) == [("a", 2), ("b", 1), ("b", 2)]
