"""Propagation between observations: daily means of each event type, at every quarter of a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import propagation as P
from ..operators import series as S
from .inputs import DAILY, daily

QUERIES, SQL = {}, {}

#: Quarters of sums of cents end in halves; this much takes them off the edge where rounding goes either way.
OFF_HALF = 3e-8

MAP = f"""{DAILY}, lg AS (SELECT event_type, t - lag(t) OVER w AS gap, lag(x) OVER w AS u, x AS v FROM dy WINDOW w AS (PARTITION BY event_type ORDER BY t)),
nm AS (SELECT *, median(gap) OVER (PARTITION BY event_type) AS h FROM lg WHERE gap IS NOT NULL),
gm AS (SELECT event_type, h, count(*) AS n, sum(u) AS su, sum(u * u) AS suu, sum(v) AS sv, sum(u * v) AS suv FROM nm WHERE abs(gap - h) <= 1e-12 + 1e-7 * abs(h) GROUP BY ALL),
mp AS (SELECT event_type, h, n, ((n + 1e-8) * suv - su * sv) / ((n + 1e-8) * (suu + 1e-8) - su * su) AS a, ((suu + 1e-8) * sv - su * suv) / ((n + 1e-8) * (suu + 1e-8) - su * su) AS b FROM gm)"""


def advanced(x: str, f: str) -> str:
    power = f"(pow(abs(a), {f}) * CASE WHEN a < 0 THEN cos(({f}) * pi()) ELSE 1 END)"
    return f"({power} * {x} + b * (1 - {power}) / (1 - a))"


GRID = """en AS (SELECT event_type, min(t) AS t0, max(t) AS t1, arg_min(x, t) AS xf FROM dy GROUP BY 1), qu AS (SELECT event_type, t0, xf, t0 + 0.25 * unnest(range(0, (4 * (t1 - t0))::BIGINT + 1)) AS t FROM en),
pv AS (SELECT qu.*, dy.t AS tp, dy.x AS xp FROM qu ASOF JOIN dy ON qu.event_type = dy.event_type AND qu.t >= dy.t),
nx AS (SELECT pv.*, dy.t AS tn, dy.x AS xn FROM pv ASOF JOIN dy ON pv.event_type = dy.event_type AND pv.t <= dy.t),
al AS (SELECT nx.*, a, b, h, CASE WHEN tn > tp THEN (t - tp) / (tn - tp) ELSE 0 END AS place FROM nx JOIN mp USING (event_type))"""
FORWARD, ROLLED = advanced("xp", "(t - tp) / h"), advanced("xf", "(t - t0) / h")
VALUE = {
    "local_reset": FORWARD,
    "global_rollout": ROLLED,
    "residual_corrected": f"{ROLLED} + (1 - place) * (xp - {advanced('xf', '(tp - t0) / h')}) + place * (xn - {advanced('xf', '(tn - t0) / h')})",
    "two_sided": f"CASE WHEN tn > tp THEN (1 - place) * {FORWARD} + place * {advanced('xn', '(t - tn) / h')} ELSE {FORWARD} END",
}


def _quarters(d):
    ends = d.groupBy("event_type").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.select("event_type", "a", F.explode(F.sequence(F.lit(0), (4 * (F.col("b") - F.col("a"))).cast("int"))).alias("i")).select("event_type", (F.col("a") + F.col("i") * 0.25).alias("t"))


def prop_one_step_map(spark, sf_dir):
    m = P.one_step_map(daily(spark, sf_dir), ["event_type"])
    return m.select("event_type", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("nominal", 6).alias("nominal"), "n")


QUERIES["prop_one_step_map"] = prop_one_step_map
SQL["prop_one_step_map"] = f"WITH {MAP} SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(h, 6) AS nominal, n FROM mp"


def _strategy(strategy: str):
    def run(spark, sf_dir):
        d = daily(spark, sf_dir)
        return P.propagate(_quarters(d), d, ["event_type"], strategy).select("event_type", "t", F.round(F.col("x") + OFF_HALF, 5).alias("x"))

    run.__name__ = f"prop_{strategy}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"WITH {MAP}, {GRID} SELECT event_type, t, round({VALUE[strategy]} + 3e-8, 5) AS x FROM al"


for _name in P.STRATEGIES:
    _strategy(_name)


def k_linear(spark, sf_dir):
    """Linear reconstruction on a grid of four steps for each of the first gap."""
    d = daily(spark, sf_dir)
    out = S.linear_interp(S.dense_grid(d, ["event_type"], 4).select("event_type", "t"), d, ["event_type"])
    return out.select("event_type", F.round("t", 6).alias("t"), F.round(F.col("x") + OFF_HALF / 10, 6).alias("x"))


QUERIES["k_linear"] = k_linear
SQL["k_linear"] = f"""WITH {DAILY}, e AS (SELECT event_type, min(t) t0, max(t) t1, (list_sort(list(t)))[2] t2 FROM dy GROUP BY 1), s AS (SELECT *, (t2 - t0) / 4 AS h FROM e WHERE t2 IS NOT NULL),
q AS (SELECT event_type, t0 + h * unnest(range(0, ceil((t1 + 0.1 * h - t0) / h)::BIGINT)) AS t FROM s), pv AS (SELECT q.*, dy.t AS tp, dy.x AS xp FROM q ASOF JOIN dy ON q.event_type = dy.event_type AND q.t >= dy.t),
nx AS (SELECT pv.*, dy.t AS tn, dy.x AS xn FROM pv ASOF LEFT JOIN dy ON pv.event_type = dy.event_type AND pv.t <= dy.t)
SELECT event_type, round(t, 6) AS t, round(CASE WHEN tn IS NULL OR tn = tp THEN xp ELSE xp + (xn - xp) * (t - tp) / (tn - tp) END + 3e-9, 6) AS x FROM nx"""
