"""Reports on records of which some failed: their numbers are NaN, and some have no method. In the SQL both are null."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting as R
from .inputs import KEYS, RECORDS, records
from .record_queries import CORE, rounded

QUERIES, SQL = {}, {}

#: The same records; those of one item failed, and every eleventh seed and setting has a tuning value that is missing.
GAPS = f"""{RECORDS}, gp AS (SELECT system, CASE WHEN noise > 0.085 AND method = 'R' THEN NULL ELSE method END AS method, setting, noise, seed, items, CASE WHEN status = 'ok' THEN support_f1 END AS support_f1,
CASE WHEN status = 'ok' THEN coef_error END AS coef_error, CASE WHEN status = 'ok' THEN practical_score END AS practical_score, CASE WHEN items % 3 = 1 THEN NULL ELSE items * 0.5::DOUBLE END AS tuning FROM rec)"""


def gappy(spark, sf_dir):
    nan, ok = F.lit(float("nan")), F.col("status") == "ok"
    r = records(spark, sf_dir)
    r = r.withColumn("tuning", F.when(F.col("items") % 3 == 1, nan).otherwise(F.col("items") * 0.5))
    r = r.withColumn("method", F.when((F.col("noise") > 0.085) & (F.col("method") == "R"), F.lit(None)).otherwise(F.col("method")))
    return r.select(*KEYS, "method", "items", "tuning", *[F.when(ok, F.col(c)).otherwise(nan).alias(c) for c in ("support_f1", "coef_error", "practical_score")])


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {GAPS} SELECT system, method, noise, {CORE} FROM gp WHERE method IS NOT NULL GROUP BY ALL")
def gap_core_summary(spark, sf_dir):
    return rounded(R.core_summary(gappy(spark, sf_dir).dropna(subset=["method"]), ["system", "method", "noise"]))


@query(f"""WITH {GAPS} SELECT system, method, round(avg(support_f1), 6) AS mean_support_f1, round(median(support_f1), 6) AS median_support_f1, round(avg(coef_error), 6) AS mean_coef_error, round(median(coef_error), 6) AS median_coef_error,
round(avg(practical_score), 6) AS mean_practical_score, round(median(practical_score), 6) AS median_practical_score, count(*) AS n FROM gp GROUP BY ALL""")
def gap_sensitivity_summary(spark, sf_dir):
    return rounded(R.sensitivity_summary(gappy(spark, sf_dir), ["system", "method"], ["support_f1", "coef_error", "practical_score"]))


@query(f"WITH {GAPS} SELECT system, method, round(median(tuning), 6) AS median_tuning, round(median(coef_error), 6) AS median_coef_error, count(coef_error) AS n FROM gp WHERE method IS NOT NULL GROUP BY ALL")
def gap_tuning_summary(spark, sf_dir):
    return rounded(R.tuning_summary(gappy(spark, sf_dir), ["system", "method"], ["tuning"], "coef_error"))


PAIRS = """pr AS (SELECT a.*, b.coef_error AS coef_error_base, b.practical_score AS practical_score_base FROM gp a JOIN gp b USING (system, setting, noise, seed) WHERE a.method != 'N' AND b.method = 'N')"""


def _pairs(spark, sf_dir):
    return R.paired(gappy(spark, sf_dir), KEYS, "method", "N", ["coef_error", "practical_score"])


@query(f"""WITH {GAPS}, {PAIRS} SELECT system, method, count(*) AS n, round(avg(CASE WHEN coef_error < coef_error_base THEN 1.0 ELSE 0.0 END), 6) AS error_win_rate,
round(avg(CASE WHEN practical_score > practical_score_base THEN 1.0 ELSE 0.0 END), 6) AS score_win_rate FROM pr GROUP BY ALL""")
def gap_win_rate(spark, sf_dir):
    return rounded(R.win_rates(_pairs(spark, sf_dir), ["system", "method"]))


@query(f"""WITH {GAPS}, {PAIRS}, d AS (SELECT *, practical_score - practical_score_base AS d FROM pr), w AS (SELECT method, count(d) AS n, avg(d) AS mean_delta, median(d) AS median_delta, sum(CASE WHEN d > 1e-12 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN abs(d) <= 1e-12 THEN 1 ELSE 0 END) AS ties FROM d GROUP BY 1),
s AS (SELECT method, seed, avg(d) AS m FROM d GROUP BY ALL), e AS (SELECT method, stddev_samp(m) / sqrt(count(m)) AS seed_se, sum(CASE WHEN m > 1e-12 THEN 1 ELSE 0 END) AS sw FROM s GROUP BY 1)
SELECT method, n, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, wins::BIGINT AS wins, ties::BIGINT AS ties, round(seed_se, 6) AS seed_se, sw::BIGINT AS seed_mean_wins FROM w JOIN e USING (method)""")
def gap_paired_delta(spark, sf_dir):
    return rounded(R.paired_deltas(_pairs(spark, sf_dir), ["method"], "seed", "practical_score"))


@query(f"""WITH {GAPS}, c AS (SELECT method, seed, sum(coef_error) AS s, count(coef_error) AS c FROM gp WHERE method IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY method) / sum(c) OVER (PARTITION BY method) AS mean FROM c)
SELECT method, round(any_value(mean), 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(pow(s - c * mean, 2))) / sum(c) END, 6) AS clustered_se, count(*) AS clusters, sum(c)::BIGINT AS n FROM m GROUP BY 1""")
def gap_clustered_se(spark, sf_dir):
    return rounded(R.clustered_se(gappy(spark, sf_dir).dropna(subset=["method"]), ["method"], "seed", "coef_error"))


@query(f"""WITH {GAPS} SELECT noise, round(median(coef_error) FILTER (WHERE method = 'A'), 6) AS "A", round(median(coef_error) FILTER (WHERE method = 'N'), 6) AS "N", round(median(coef_error) FILTER (WHERE method = 'R'), 6) AS "R" FROM gp GROUP BY 1""")
def gap_pivot_median(spark, sf_dir):
    return rounded(R.pivot_median(gappy(spark, sf_dir), ["noise"], "method", ["A", "N", "R"], "coef_error"))


@query(f"WITH {GAPS} SELECT setting, count(*) AS n FROM gp WHERE coef_error IS NOT NULL AND practical_score > 0.2 AND setting LIKE '1%' GROUP BY 1")
def gap_finite(spark, sf_dir):
    r = gappy(spark, sf_dir).where(R.finite("coef_error", "practical_score") & (F.col("practical_score") > 0.2) & F.col("setting").startswith("1"))
    return r.groupBy("setting").agg(F.count("*").alias("n"))


@query(f"""WITH {GAPS}, s AS (SELECT method, avg(practical_score) AS m FROM gp WHERE method IS NOT NULL GROUP BY 1), o AS (SELECT 0 AS position, 'R' AS method UNION ALL SELECT 1, 'X')
SELECT position::INT AS position, method, round(m, 6) AS mean_score FROM o LEFT JOIN s USING (method) UNION ALL SELECT (1 + row_number() OVER (ORDER BY method))::INT, method, round(m, 6) FROM s WHERE method NOT IN ('R', 'X')""")
def gap_ordered_methods(spark, sf_dir):
    s = gappy(spark, sf_dir).dropna(subset=["method"]).groupBy("method").agg(F.avg(R.clean("practical_score")).alias("mean_score"))
    return rounded(R.ordered_by(s, "method", ["R", "X"], append=True).select("position", "method", "mean_score"))
