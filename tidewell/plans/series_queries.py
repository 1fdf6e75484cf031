"""Series operators on the table events: one series for each user, or daily means for each type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from .inputs import DAILY, EVENTS, daily, events, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


W = "OVER (PARTITION BY user_id ORDER BY t)"


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, event_id, lag(t) {W} a, lead(t) {W} b, lag(x) {W} xa, lead(x) {W} xb FROM ev)
SELECT user_id, event_id, round((xb - xa) / (b - a), 6) AS dxdt FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def ts_central_difference(spark, sf_dir):
    return r6(S.central_difference(events(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "dxdt"), "dxdt")


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, event_id, (x - lag(x) {W}) / (t - lag(t) {W}) p, (lead(x) {W} - x) / (lead(t) {W} - t) n FROM ev)
SELECT user_id, event_id, round(CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p ELSE (p + n) / 2 END, 6) AS dxdt FROM w""")
def ts_nodal_derivative(spark, sf_dir):
    return r6(S.nodal_derivative(events(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "dxdt"), "dxdt")


@query(f"""WITH {EVENTS}, w AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, event_id, round(t, 6) AS t FROM w WHERE i % 4 = 0 OR i = n - 1""")
def ts_subsample_append_last(spark, sf_dir):
    return r6(S.subsample(events(spark, sf_dir), ["user_id"], 4).select("user_id", "event_id", "t"), "t")


@query(f"""WITH {EVENTS}, w AS (SELECT *, row_number() {W} - 1 AS i FROM ev)
SELECT user_id, event_id, round(t, 6) AS t FROM w WHERE i % 4 = 0 AND t <= 480 + 1e-10""")
def ts_subsample_cropped(spark, sf_dir):
    return r6(S.subsample(events(spark, sf_dir), ["user_id"], 4, keep_last=False, horizon=480.0).select("user_id", "event_id", "t"), "t")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, event_id, t - lag(t) {W} AS gap FROM ev), h AS (SELECT *, median(gap) OVER (PARTITION BY user_id) AS nominal FROM g WHERE gap IS NOT NULL)
SELECT user_id, event_id, round(gap, 6) AS gap, round(nominal, 6) AS nominal, abs(gap - nominal) <= 1e-12 + 0.25 * abs(nominal) AS usable FROM h""")
def ts_gap_nominal_pairs(spark, sf_dir):
    return r6(S.nominal_pairs(events(spark, sf_dir), ["user_id"], rtol=0.25).select("user_id", "event_id", "gap", "nominal", "usable"), "gap", "nominal")


@query(f"""WITH {DAILY}, e AS (SELECT event_type, min(t) t0, max(t) t1, (list_sort(list(t)))[2] t2 FROM dy GROUP BY 1), s AS (SELECT *, (t2 - t0) / 4 AS h FROM e WHERE t2 IS NOT NULL),
i AS (SELECT *, unnest(range(0, ceil((t1 + 0.1 * h - t0) / h)::BIGINT)) AS i FROM s) SELECT event_type, i::INT AS i, round(t0 + i * h, 6) AS t FROM i""")
def ts_dense_grid(spark, sf_dir):
    return r6(S.dense_grid(daily(spark, sf_dir), ["event_type"], 4), "t")


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, min(t) t0, max(t) t1, 2 * (count(*) - 1) AS m FROM ev GROUP BY 1 HAVING count(*) > 1), i AS (SELECT *, unnest(range(0, m + 1)) AS i FROM e)
SELECT user_id, i::INT AS i, round(t0 + (t1 - t0) * i / m, 6) AS t FROM i""")
def ts_dense_grid_exact(spark, sf_dir):
    return r6(S.dense_grid_exact(events(spark, sf_dir), ["user_id"], 2), "t")


def _midnights(ev):
    """(user_id, t): every 24 hours within each user's series."""
    ends = ev.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    days = F.sequence(F.ceil(F.col("a") / 24).cast("int"), F.floor(F.col("b") / 24).cast("int"))
    return ends.where(F.floor(F.col("b") / 24) >= F.ceil(F.col("a") / 24)).select("user_id", F.explode(days).alias("d")).select("user_id", (F.col("d") * 24.0).alias("t"))


MIDNIGHTS = """e AS (SELECT user_id, min(t) a, max(t) b FROM ev GROUP BY 1), q AS (SELECT user_id, unnest(range(ceil(a / 24)::BIGINT, floor(b / 24)::BIGINT + 1)) * 24.0::DOUBLE AS t FROM e)"""


@query(f"""WITH {EVENTS}, {MIDNIGHTS} SELECT q.user_id, q.t, round(ev.t, 6) AS t_prev, round(ev.x, 6) AS x_prev FROM q ASOF JOIN ev ON q.user_id = ev.user_id AND q.t >= ev.t""")
def ts_anchor_asof(spark, sf_dir):
    ev = events(spark, sf_dir)
    return r6(S.asof_anchor(_midnights(ev), ev, ["user_id"]).select("user_id", "t", "t_prev", "x_prev"), "t_prev", "x_prev")


@query(f"""WITH {EVENTS}, {MIDNIGHTS}, p AS (SELECT q.user_id, q.t, ev.t AS tp, ev.x AS xp FROM q ASOF JOIN ev ON q.user_id = ev.user_id AND q.t >= ev.t),
b AS (SELECT p.*, ev.t AS tn, ev.x AS xn FROM p ASOF LEFT JOIN ev ON p.user_id = ev.user_id AND p.t <= ev.t)
SELECT user_id, t, round(CASE WHEN tn IS NULL OR t - tp <= tn - t THEN tp ELSE tn END, 6) AS t_near, round(CASE WHEN tn IS NULL OR t - tp <= tn - t THEN xp ELSE xn END, 6) AS x_near FROM b""")
def ts_nearest_anchor(spark, sf_dir):
    ev = events(spark, sf_dir)
    return r6(S.nearest_anchor(_midnights(ev), ev, ["user_id"]).select("user_id", "t", "t_near", "x_near"), "t_near", "x_near")


@query(f"""WITH {EVENTS}, {MIDNIGHTS}, p AS (SELECT q.user_id, q.t, ev.t AS tp, ev.x AS xp FROM q ASOF JOIN ev ON q.user_id = ev.user_id AND q.t >= ev.t),
b AS (SELECT p.*, ev.t AS tn, ev.x AS xn FROM p ASOF LEFT JOIN ev ON p.user_id = ev.user_id AND p.t <= ev.t)
SELECT user_id, t, round(CASE WHEN tn IS NULL OR tn = tp THEN xp ELSE xp + (xn - xp) * (t - tp) / (tn - tp) END, 6) AS x FROM b""")
def ts_linear_interp(spark, sf_dir):
    ev = events(spark, sf_dir)
    return r6(S.linear_interp(_midnights(ev), ev, ["user_id"]), "x")


FOLDS = f"""n AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev), f AS (SELECT *, CASE WHEN i = 0 OR i = n - 1 THEN -1 ELSE (i - 1) % greatest(2, least(4, n - 2)) END AS fold FROM n WHERE n >= 6)"""


@query(f"""WITH {EVENTS}, {FOLDS} SELECT user_id, event_id, fold::INT AS fold FROM f""")
def ts_interior_folds(spark, sf_dir):
    return S.interior_folds(events(spark, sf_dir), ["user_id"], 4).select("user_id", "event_id", "fold")


@query(f"""WITH {EVENTS}, {FOLDS}, k AS (SELECT DISTINCT user_id, fold AS k FROM f WHERE fold >= 0), tr AS (SELECT f.user_id, k, t, x FROM f JOIN k USING (user_id) WHERE fold != k), he AS (SELECT f.user_id, k, t, x FROM f JOIN k USING (user_id) WHERE fold = k),
p AS (SELECT he.user_id, he.k, he.t, he.x, tr.t AS tp, tr.x AS xp FROM he ASOF JOIN tr ON he.user_id = tr.user_id AND he.k = tr.k AND he.t >= tr.t),
b AS (SELECT p.*, tr.t AS tn, tr.x AS xn FROM p ASOF JOIN tr ON p.user_id = tr.user_id AND p.k = tr.k AND p.t <= tr.t), v AS (SELECT user_id, k, var_pop(x) AS v FROM tr GROUP BY ALL)
SELECT user_id, k::INT AS fold, round(avg(pow(CASE WHEN tn = tp THEN xp ELSE xp + (xn - xp) * (t - tp) / (tn - tp) END - x, 2) / greatest(v, 1e-12)), 6) AS mse FROM b JOIN v USING (user_id, k) GROUP BY user_id, k""")
def ts_fold_interp_mse(spark, sf_dir):
    return r6(S.fold_interp_mse(events(spark, sf_dir), ["user_id"], 4), "mse")


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, t, x AS x0, lead(x, 1) {W} AS x1, lead(x, 2) {W} AS x2, lead(t, 2) {W} AS l FROM ev) SELECT user_id, round(t, 6) AS t, x0, x1, x2 FROM w WHERE l IS NOT NULL""")
def ts_hankel_embed(spark, sf_dir):
    return r6(S.delay_embedding(events(spark, sf_dir), ["user_id"], 3), "t")


@query(f"""WITH {EVENTS}, a AS (SELECT *, event_id % 3 != 1 AS tr FROM ev), b AS (SELECT *, avg(x) FILTER (WHERE tr) OVER (PARTITION BY user_id) AS m, greatest(stddev_pop(x) FILTER (WHERE tr) OVER (PARTITION BY user_id), 1e-12) AS s FROM a)
SELECT user_id, event_id, round(m, 6) AS mean, round(s, 6) AS std, round(CASE WHEN tr THEN (x - m) / s ELSE 0 END, 6) AS z FROM b""")
def ts_standardize_train(spark, sf_dir):
    out = S.standardize_train(events(spark, sf_dir), ["user_id"], F.col("event_id") % 3 != 1)
    return r6(out.select("user_id", "event_id", "mean", "std", "z"), "mean", "std", "z")


@query("""WITH a AS (SELECT user_id, event_type, stddev_samp(value) AS s FROM events GROUP BY ALL), b AS (SELECT user_id, greatest(stddev_pop(value), 1e-12) AS m FROM events GROUP BY 1)
SELECT user_id, event_type, round(0.1 * CASE WHEN coalesce(s, 0) < 1e-12 THEN m ELSE s END, 6) AS sigma FROM a JOIN b USING (user_id)""")
def ts_noise_sigma(spark, sf_dir):
    from .inputs import table

    return r6(S.noise_sigma(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value"), "sigma")


@query("""SELECT user_id, round(0.1 * greatest(stddev_pop(value), 1e-12), 6) AS sigma FROM events GROUP BY 1""")
def ts_noise_sigma_global(spark, sf_dir):
    from .inputs import table

    return r6(S.noise_sigma_global(table(spark, sf_dir, "events"), ["user_id"], "value"), "sigma")


@query(f"""WITH {EVENTS} SELECT user_id, event_id, (sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM ev""")
def ts_segment_id(spark, sf_dir):
    return S.segment_id(events(spark, sf_dir), ["user_id"], F.col("event_id") % 5 == 0).select("user_id", "event_id", "segment")


@query(f"""WITH {EVENTS} SELECT user_id, event_id, round(sum(x * x) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) / greatest(sum(x * x) OVER (PARTITION BY user_id), 1e-300), 6) AS fraction FROM ev""")
def ts_cumulative_energy(spark, sf_dir):
    return r6(S.cumulative_energy(events(spark, sf_dir), ["user_id"], "t").select("user_id", "event_id", "fraction"), "fraction")


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, sum(x * x) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(x * x) OVER (PARTITION BY user_id) AS f FROM ev)
SELECT user_id, greatest(1, least(10, sum(CASE WHEN f < 0.5 THEN 1 ELSE 0 END) + 1))::INT AS rank FROM c GROUP BY 1""")
def ts_energy_rank(spark, sf_dir):
    return S.energy_rank(events(spark, sf_dir), ["user_id"], "t", energy=0.5)


@query(f"""WITH {EVENTS} SELECT user_id, event_id, round((t - min(t) OVER (PARTITION BY user_id)) / greatest(max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id), 1e-12), 6) AS tau FROM ev""")
def ts_normalized_time(spark, sf_dir):
    return r6(S.normalized_time(events(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "tau"), "tau")


#: Antiderivatives of (1 - s^2)^4, of s times it, of its derivative and of s times that.
def _moments(s):
    whole = f"({s} - 4 * pow({s}, 3) / 3 + 6 * pow({s}, 5) / 5 - 4 * pow({s}, 7) / 7 + pow({s}, 9) / 9)"
    return whole, f"(pow({s}, 2) / 2 - pow({s}, 4) + pow({s}, 6) - pow({s}, 8) / 2 + pow({s}, 10) / 10)", f"pow(1 - {s} * {s}, 4)", f"({s} * pow(1 - {s} * {s}, 4) - {whole})"


_PIECES = ", ".join(f"{b} - {a} AS {name}" for name, a, b in zip(("i0", "i1", "d0", "d1"), _moments("lo"), _moments("hi")))


@query(f"""WITH {DAILY}, a AS (SELECT *, lead(t) OVER w AS t2, lead(x) OVER w AS x2, min(t) OVER (PARTITION BY event_type) AS t0, max(t) OVER (PARTITION BY event_type) AS t1 FROM dy WINDOW w AS (PARTITION BY event_type ORDER BY t)),
j AS (SELECT *, unnest(range(0, greatest(0, floor((t1 - t0 - 8) / 2 + 1e-9)::BIGINT + 1))) AS j FROM a WHERE t2 > t), s AS (SELECT *, (t - (t0 + 4 + j * 2)) / 4 AS s, (t2 - (t0 + 4 + j * 2)) / 4 AS s2 FROM j),
c AS (SELECT *, greatest(s, -1) AS lo, least(s2, 1) AS hi FROM s), p AS (SELECT *, {_PIECES} FROM c WHERE hi > lo)
SELECT event_type, j::INT AS j, round(t0 + 4 + j * 2, 6) AS center, round(4 * sum((x * (s2 * i0 - i1) + x2 * (i1 - s * i0)) / (s2 - s)), 6) AS integral, round(-sum((x * (s2 * d0 - d1) + x2 * (d1 - s * d0)) / (s2 - s)), 6) AS target, count(*) AS n
FROM p GROUP BY event_type, j, t0""")
def ts_weak_windows(spark, sf_dir):
    return r6(S.weak_windows(daily(spark, sf_dir), ["event_type"], 4.0, 2.0), "center", "integral", "target")


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, event_id, lag(t) {W} a, lead(t) {W} b, lag(x) {W} xa, lead(x) {W} xb FROM ev)
SELECT user_id, event_id, round((xb - xa) / (b - a), 6) AS d0, round((xb - xa) * 2 / (b - a), 6) AS d1 FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def ts_central_difference_arrays(spark, sf_dir):
    s = events(spark, sf_dir).withColumn("state", F.array("x", 2 * F.col("x")))
    d = S.central_difference_arrays(s, ["user_id"])
    return r6(d.select("user_id", "event_id", F.col("derivative")[0].alias("d0"), F.col("derivative")[1].alias("d1")), "d0", "d1")


@query(f"""WITH {EVENTS}, b AS (SELECT *, avg(x) FILTER (WHERE event_id % 3 != 1) OVER (PARTITION BY user_id) AS m FROM ev) SELECT user_id, event_id, round(CASE WHEN event_id % 3 != 1 THEN x ELSE m END, 6) AS x FROM b""")
def ts_unstandardize(spark, sf_dir):
    """Back from standardised values; held-out rows stand at the mean."""
    z = S.standardize_train(events(spark, sf_dir), ["user_id"], F.col("event_id") % 3 != 1)
    return r6(S.unstandardize(z.drop("x")).select("user_id", "event_id", "x"), "x")


@query(f"""WITH {EVENTS} SELECT user_id, event_id, round(t, 6) AS t_prev FROM ev""")
def ts_asof_tolerance(spark, sf_dir):
    """Queries an ulp before their anchors count as at them."""
    ev = events(spark, sf_dir)
    q = ev.select("user_id", (F.col("t") * (1 - 1e-13)).alias("t"))
    found = S.asof_anchor(q, ev.withColumn("v", F.col("event_id").cast("double")), ["user_id"], x="v")
    return r6(found.select("user_id", F.col("x_prev").cast("long").alias("event_id"), "t_prev"), "t_prev")


_DRAW = "sqrt(-2 * ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5) / 4503599627370496)) * cos(2 * pi() * ((('0x' || substr(h, 14, 13))::BIGINT + 0.5) / 4503599627370496))"


@query(f"""WITH c AS (SELECT user_id, event_type, stddev_samp(value) AS s, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT user_id, greatest(stddev_pop(value), 1e-12) AS p FROM events GROUP BY 1),
sg AS (SELECT user_id, event_type, 0.1 * CASE WHEN coalesce(s, 0) < 1e-12 THEN p ELSE s END AS sigma FROM c JOIN w USING (user_id)), h AS (SELECT *, md5(concat_ws('|', '7', user_id, event_type, event_id)) AS h FROM events)
SELECT user_id, event_id, round(value + sigma * {_DRAW}, 6) AS noisy FROM h JOIN sg USING (user_id, event_type)""")
def ts_add_noise(spark, sf_dir):
    """Each event's value with a draw of a tenth of its type's deviation for that user, the same on every run."""
    noisy = S.add_noise(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.lit(7), 0.1, "event_type", "value")
    return r6(noisy.select("user_id", "event_id", "noisy"), "noisy")


@query(f"""WITH sg AS (SELECT user_id, 0.1 * greatest(stddev_pop(value), 1e-12) AS sigma FROM events GROUP BY 1), h AS (SELECT *, md5(concat_ws('|', '7', user_id, event_id)) AS h FROM events)
SELECT user_id, event_id, round(value + sigma * {_DRAW}, 6) AS noisy FROM h JOIN sg USING (user_id)""")
def ts_add_noise_global(spark, sf_dir):
    noisy = S.add_noise(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.lit(7), 0.1, None, "value")
    return r6(noisy.select("user_id", "event_id", "noisy"), "noisy")
