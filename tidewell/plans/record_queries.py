"""Reports on records made of line items, orders, customers and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as X
from ..operators import reporting as R
from .inputs import KEYS, RECORDS, records, table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c != "noise" else c for c, t in df.dtypes])


CORE = "round(avg(support_f1), 6) AS mean_f1, round(stddev_samp(support_f1), 6) AS std_f1, round(median(coef_error), 6) AS median_error, round(avg(coef_error), 6) AS mean_error, round(avg(practical_score), 6) AS mean_score, count(*) AS n"


@query(f"WITH {RECORDS} SELECT system, method, noise, {CORE} FROM rec WHERE status = 'ok' GROUP BY ALL")
def rpt_core_summary(spark, sf_dir):
    return rounded(R.core_summary(records(spark, sf_dir).where("status = 'ok'"), ["system", "method", "noise"]))


@query(f"WITH {RECORDS} SELECT method, {CORE} FROM rec WHERE status = 'ok' GROUP BY ALL")
def rpt_overall(spark, sf_dir):
    return rounded(R.core_summary(records(spark, sf_dir).where("status = 'ok'"), ["method"]))


@query(f"WITH {RECORDS} SELECT setting, method, {CORE} FROM rec GROUP BY ALL")
def rpt_strategy_summary(spark, sf_dir):
    return rounded(R.core_summary(records(spark, sf_dir), ["setting", "method"]))


@query(f"""WITH {RECORDS} SELECT system, method, round(avg(coef_error), 6) AS mean, round(median(coef_error), 6) AS median, round(min(coef_error), 6) AS lowest, round(max(coef_error), 6) AS highest,
sum(CASE WHEN support_f1 > 0.5 THEN 1 ELSE 0 END)::BIGINT AS exact_count, round(avg(CASE WHEN support_f1 > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, count(DISTINCT seed) AS n_seeds, count(*) AS n FROM rec GROUP BY ALL""")
def rpt_extended_summary(spark, sf_dir):
    return rounded(R.extended_summary(records(spark, sf_dir).withColumn("exact", F.col("support_f1") > 0.5), ["system", "method"], "coef_error", "exact", "seed"))


@query(f"""WITH {RECORDS} SELECT noise, round(median(coef_error) FILTER (WHERE method = 'A'), 6) AS "A", round(median(coef_error) FILTER (WHERE method = 'N'), 6) AS "N", round(median(coef_error) FILTER (WHERE method = 'R'), 6) AS "R" FROM rec GROUP BY 1""")
def rpt_pivot_median(spark, sf_dir):
    return rounded(R.pivot_median(records(spark, sf_dir), ["noise"], "method", ["A", "N", "R"], "coef_error"))


@query(f"""WITH {RECORDS} SELECT system, method, noise, seed, round(avg(coef_error), 6) AS mean, round(stddev_samp(coef_error), 6) AS sd, count(coef_error) AS n, round(median(coef_error), 6) AS median, round(max(coef_error), 6) AS highest
FROM rec GROUP BY GROUPING SETS ((system, method, noise), (system, method, seed))""")
def rpt_grouping_sets(spark, sf_dir):
    return rounded(R.grouping_sets(records(spark, sf_dir), [["system", "method", "noise"], ["system", "method", "seed"]], "coef_error"))


PAIRS = """pr AS (SELECT a.*, b.coef_error AS coef_error_base, b.practical_score AS practical_score_base FROM rec a JOIN rec b USING (system, setting, noise, seed) WHERE a.method != 'N' AND b.method = 'N')"""


def _pairs(spark, sf_dir):
    return R.paired(records(spark, sf_dir), KEYS, "method", "N", ["coef_error", "practical_score"])


@query(f"""WITH {RECORDS}, {PAIRS} SELECT system, method, count(*) AS n, round(avg(CASE WHEN coef_error < coef_error_base THEN 1.0 ELSE 0.0 END), 6) AS error_win_rate, round(avg(CASE WHEN practical_score > practical_score_base THEN 1.0 ELSE 0.0 END), 6) AS score_win_rate FROM pr GROUP BY ALL""")
def rpt_win_rate(spark, sf_dir):
    return rounded(R.win_rates(_pairs(spark, sf_dir), ["system", "method"]))


@query(f"""WITH {RECORDS}, {PAIRS}, d AS (SELECT *, practical_score - practical_score_base AS d FROM pr), w AS (SELECT method, count(d) AS n, avg(d) AS mean_delta, median(d) AS median_delta, sum(CASE WHEN d > 1e-12 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN abs(d) <= 1e-12 THEN 1 ELSE 0 END) AS ties FROM d GROUP BY 1),
s AS (SELECT method, seed, avg(d) AS m FROM d GROUP BY ALL), e AS (SELECT method, stddev_samp(m) / sqrt(count(m)) AS seed_se, sum(CASE WHEN m > 1e-12 THEN 1 ELSE 0 END) AS sw FROM s GROUP BY 1)
SELECT method, n, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, wins::BIGINT AS wins, ties::BIGINT AS ties, round(seed_se, 6) AS seed_se, sw::BIGINT AS seed_mean_wins FROM w JOIN e USING (method)""")
def rpt_paired_delta(spark, sf_dir):
    return rounded(R.paired_deltas(_pairs(spark, sf_dir), ["method"], "seed", "practical_score"))


@query(f"""WITH {RECORDS} SELECT a.system, a.setting, a.noise, a.seed, a.method, b.method AS comparator, round(a.coef_error - b.coef_error, 6) AS coef_error_delta FROM rec a JOIN rec b USING (system, setting, noise, seed) WHERE a.method != b.method AND b.method IN ('N', 'R')""")
def rpt_record_comparisons(spark, sf_dir):
    return rounded(R.record_comparisons(records(spark, sf_dir), KEYS, "method", ["N", "R"], ["coef_error"]))


@query(f"""WITH {RECORDS}, c AS (SELECT method, seed, sum(coef_error) AS s, count(*) AS c FROM rec GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY method) / sum(c) OVER (PARTITION BY method) AS mean FROM c)
SELECT method, round(any_value(mean), 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(pow(s - c * mean, 2))) / sum(c) END, 6) AS clustered_se, count(*) AS clusters, sum(c)::BIGINT AS n FROM m GROUP BY method""")
def rpt_clustered_se(spark, sf_dir):
    return rounded(R.clustered_se(records(spark, sf_dir), ["method"], "seed", "coef_error"))


@query(f"""WITH {RECORDS}, s AS (SELECT system, method, seed, avg(practical_score) AS m FROM rec GROUP BY ALL) SELECT system, method, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, count(m) AS n_seeds FROM s GROUP BY ALL""")
def rpt_seed_sem(spark, sf_dir):
    return rounded(R.seed_sem(records(spark, sf_dir), ["system", "method"], "seed", "practical_score"))


@query(f"""WITH {RECORDS} SELECT system, setting, noise, seed, method, round(practical_score, 6) AS practical_score FROM rec QUALIFY row_number() OVER (PARTITION BY system, setting, noise, seed ORDER BY practical_score DESC, coef_error, method) = 1""")
def rpt_best_by_case(spark, sf_dir):
    best = R.top_one(records(spark, sf_dir), KEYS, F.col("practical_score").desc(), F.col("coef_error"), F.col("method"))
    return rounded(best.select(*KEYS, "method", "practical_score"))


@query(f"""WITH {RECORDS} SELECT system, setting, noise, seed, method, round(coef_error - min(coef_error) OVER (PARTITION BY system, setting, noise, seed), 6) AS delta FROM rec""")
def rpt_delta_from_min(spark, sf_dir):
    return rounded(R.delta_from_min(records(spark, sf_dir), KEYS, "coef_error").select(*KEYS, "method", "delta"))


@query(f"""WITH {RECORDS}, s AS (SELECT system, method, median(coef_error) AS median_error FROM rec GROUP BY ALL) SELECT system, method, round(median_error, 6) AS median_error, round(median_error, 3) = min(round(median_error, 3)) OVER (PARTITION BY system) AS is_best FROM s""")
def rpt_best_marks(spark, sf_dir):
    s = R.core_summary(records(spark, sf_dir), ["system", "method"]).select("system", "method", "median_error")
    return rounded(R.best_marks(s, ["system"], "median_error"))


@query(f"""WITH {RECORDS}, c AS (SELECT system, method, items, count(*) AS c, sum(CASE WHEN items = 2 THEN 1 ELSE 0 END) AS h FROM rec GROUP BY ALL), t AS (SELECT system, method, sum(h)::DOUBLE / sum(c) AS rate, sum(c)::BIGINT AS n FROM c GROUP BY ALL),
m AS (SELECT system, method, items AS mode FROM c QUALIFY row_number() OVER (PARTITION BY system, method ORDER BY c DESC, items) = 1) SELECT system, method, mode, round(rate, 6) AS rate, n FROM m JOIN t USING (system, method)""")
def rpt_mode_exact_rate(spark, sf_dir):
    return rounded(R.mode_and_rate(records(spark, sf_dir), ["system", "method"], "items", F.col("items") == 2))


@query(f"""WITH {RECORDS} SELECT method, CASE WHEN noise <= 0.03 THEN 'low' WHEN noise <= 0.07 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(avg(practical_score), 6) AS mean_score FROM rec GROUP BY ALL""")
def rpt_bands(spark, sf_dir):
    band = R.bands("noise", [(0.03, "low"), (0.07, "middle")], "high")
    return rounded(records(spark, sf_dir).groupBy("method", band.alias("band")).agg(F.count("*").alias("n"), F.avg("practical_score").alias("mean_score")))


@query(f"""WITH {RECORDS} SELECT method, round(quantile_cont(coef_error, 0.95), 6) AS p95 FROM rec GROUP BY 1""")
def rpt_percentile95(spark, sf_dir):
    return rounded(R.quantiles(records(spark, sf_dir), ["method"], {"p95": "coef_error"}, 0.95))


@query(f"""WITH {RECORDS} SELECT system, method, sum(CASE WHEN noise <= 0 OR noise >= 0.1 THEN 1 ELSE 0 END)::BIGINT AS edge_hits, min(noise) AS lowest, max(noise) AS highest FROM rec GROUP BY ALL""")
def rpt_tuning_edges(spark, sf_dir):
    edge = ((F.col("noise") <= 0) | (F.col("noise") >= 0.1)).cast("int")
    return records(spark, sf_dir).groupBy("system", "method").agg(F.sum(edge).alias("edge_hits"), F.min("noise").alias("lowest"), F.max("noise").alias("highest"))


@query(f"""WITH {RECORDS} SELECT status, count(*) AS n FROM rec GROUP BY 1""")
def rpt_value_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, o(position, method) AS (VALUES (0, 'R'), (1, 'X'), (2, 'A')), s AS (SELECT method, avg(practical_score) AS m FROM rec GROUP BY 1) SELECT position, method, round(m, 6) AS mean_score FROM o LEFT JOIN s USING (method)""")
def rpt_ordered_methods(spark, sf_dir):
    s = records(spark, sf_dir).groupBy("method").agg(F.avg("practical_score").alias("mean_score"))
    return rounded(R.ordered_by(s, "method", ["R", "X", "A"]).select("position", "method", "mean_score"))


@query(f"""WITH {RECORDS} SELECT DISTINCT method, CASE method WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE method END AS label FROM rec""")
def rpt_labels(spark, sf_dir):
    return R.labelled(records(spark, sf_dir).select("method").distinct(), "method", {"A": "accepted", "R": "returned"}, "label")


@query(f"""WITH {RECORDS}, nw AS (SELECT system, 'R' AS method, setting, noise, seed, 2 * support_f1 AS support_f1 FROM rec WHERE method = 'N') SELECT system, method, count(*) AS n, round(sum(support_f1), 4) AS total FROM (SELECT system, method, support_f1 FROM rec WHERE method NOT IN (SELECT method FROM nw) UNION ALL SELECT system, method, support_f1 FROM nw) GROUP BY ALL""")
def set_replace_by_method(spark, sf_dir):
    old = records(spark, sf_dir)
    new = old.where("method = 'N'").select("system", F.lit("R").alias("method"), "setting", "noise", "seed", (2 * F.col("support_f1")).alias("support_f1"))
    out = X.replace_by_method(old, new)
    return out.groupBy("system", "method").agg(F.count("*").alias("n"), F.round(F.sum("support_f1"), 4).alias("total"))


@query(f"""WITH {RECORDS}, k AS (SELECT system, setting, noise, seed FROM rec WHERE method IN ('A', 'N', 'R') GROUP BY ALL HAVING count(DISTINCT method) = 3) SELECT system, setting, noise, seed, method FROM rec SEMI JOIN k USING (system, setting, noise, seed)""")
def set_common_keys(spark, sf_dir):
    return X.common_keys(records(spark, sf_dir), KEYS, "method", ["A", "N", "R"]).select(*KEYS, "method")


@query(f"""WITH {RECORDS} SELECT system, setting, noise, seed FROM rec WHERE method = 'A' INTERSECT SELECT system, setting, noise, seed FROM rec WHERE method = 'R'""")
def set_intersect(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.where("method = 'A'").select(*KEYS).intersect(r.where("method = 'R'").select(*KEYS))


@query(f"""WITH {RECORDS} SELECT system, setting, noise, seed FROM rec WHERE method = 'N' EXCEPT SELECT system, setting, noise, seed FROM rec WHERE method = 'R'""")
def set_except(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.where("method = 'N'").select(*KEYS).subtract(r.where("method = 'R'").select(*KEYS))


GRID = """gr AS (SELECT r_name AS system, m AS method, s AS seed FROM region, (SELECT unnest(['A', 'N', 'R', 'X']) AS m), (SELECT unnest(range(1, 9)) AS s))"""


@query(f"""WITH {GRID} SELECT system, method, seed::INT AS seed FROM gr""")
def set_param_grid(spark, sf_dir):
    from .inputs import table

    systems = table(spark, sf_dir, "region").select(F.col("r_name").alias("system"))
    return X.combinations(systems, X.parameter_grid(spark, method=["A", "N", "R", "X"], seed=list(range(1, 9))))


@query(f"""WITH {RECORDS}, {GRID} SELECT system, method, seed::INT AS seed FROM gr WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.system = gr.system AND rec.method = gr.method AND rec.seed = gr.seed)""")
def set_resume_anti(spark, sf_dir):
    return X.remaining(set_param_grid(spark, sf_dir), records(spark, sf_dir), ["system", "method", "seed"])


@query(f"""WITH {RECORDS}, nw AS (SELECT system, setting, noise, seed, method, round(coef_error * 1.25, 9) AS coef_error FROM rec) SELECT system, setting, noise, seed, method, round(abs(nw.coef_error - rec.coef_error), 6) AS coef_error_drift FROM rec JOIN nw USING (system, setting, noise, seed, method)""")
def set_drift(spark, sf_dir):
    r = records(spark, sf_dir)
    return rounded(X.drift(r, r.withColumn("coef_error", F.round(F.col("coef_error") * 1.25, 9)), [*KEYS, "method"], ["coef_error"]))


@query(f"""WITH {RECORDS} SELECT system, noise, seed, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) > 1""")
def chk_duplicate_keys(spark, sf_dir):
    return R.duplicate_keys(records(spark, sf_dir), ["system", "noise", "seed"])


@query(f"""WITH {RECORDS} SELECT system, setting, noise, seed, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) = 3 AND bool_and(status = 'ok')""")
def chk_group_complete(spark, sf_dir):
    return R.complete_groups(records(spark, sf_dir), KEYS, F.col("status") == "ok", 3)


@query(f"""WITH {RECORDS} SELECT DISTINCT method FROM rec WHERE method NOT IN ('A', 'N')""")
def chk_unknown_values(spark, sf_dir):
    return X.unknown_values(records(spark, sf_dir), "method", ["A", "N"])


@query(f"""WITH {RECORDS} SELECT DISTINCT noise, seed, (seed + 1000 * 8 + 100000 * trunc(noise * 1000.0::DOUBLE))::BIGINT AS record_seed FROM rec""")
def seed_formula(spark, sf_dir):
    return records(spark, sf_dir).select("noise", "seed").distinct().select("noise", "seed", X.record_seed(F.col("seed"), F.lit(8), F.col("noise")).alias("record_seed"))


@query(f"""WITH {RECORDS} SELECT DISTINCT noise, seed, ((10000000 + 2 * 1000000 + seed + 1000 * 8 + 100000 * round(noise * 1000.0::DOUBLE))::BIGINT % 4294967295)::BIGINT AS paired_seed FROM rec""")
def seed_paired(spark, sf_dir):
    return records(spark, sf_dir).select("noise", "seed").distinct().select("noise", "seed", X.paired_seed(F.lit(2), F.lit(True), F.lit(8), F.col("noise"), F.col("seed")).alias("paired_seed"))


@query(f"""WITH {RECORDS} SELECT system, method, count(*) AS n FROM rec WHERE status = 'ok' AND support_f1 BETWEEN 0.2 AND 0.8 AND setting LIKE '%URGENT%' AND method IN ('A', 'R') GROUP BY ALL""")
def flt_conjunction(spark, sf_dir):
    r = records(spark, sf_dir).where(R.finite("support_f1", "coef_error"))
    r = r.where((F.col("status") == "ok") & F.col("support_f1").between(0.2, 0.8) & F.col("setting").contains("URGENT") & F.col("method").isin("A", "R"))
    return r.groupBy("system", "method").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, {GRID}, ok AS (SELECT system, method, seed, count(*) AS n_ok, avg(practical_score) AS m FROM rec WHERE status = 'ok' GROUP BY ALL)
SELECT gr.system, gr.method, gr.seed::INT AS seed, coalesce(n_ok, 0) AS n_ok, round(m, 6) AS mean_score FROM gr LEFT JOIN ok ON ok.system = gr.system AND ok.method = gr.method AND ok.seed = gr.seed""")
def rpt_planned_counts(spark, sf_dir):
    ok = records(spark, sf_dir).where("status = 'ok'").groupBy("system", "method", "seed").agg(F.count("*").alias("n_ok"), F.avg("practical_score").alias("mean_score"))
    out = set_param_grid(spark, sf_dir).join(ok, ["system", "method", "seed"], "left")
    return rounded(out.withColumn("n_ok", F.coalesce("n_ok", F.lit(0)).cast("long")))


@query(f"""WITH {RECORDS} SELECT system, method, round(min(coef_error), 6) AS lowest, round(max(coef_error), 6) AS highest, round(arg_min(practical_score, setting || '/' || noise::DECIMAL(4,2)::VARCHAR || '/' || seed::VARCHAR), 6) AS first_score, sum(items)::BIGINT AS items FROM rec GROUP BY ALL""")
def rpt_first_by_order(spark, sf_dir):
    order = F.concat_ws("/", "setting", F.col("noise").cast("decimal(4,2)").cast("string"), F.col("seed").cast("string"))
    g = records(spark, sf_dir).groupBy("system", "method")
    return rounded(g.agg(F.min("coef_error").alias("lowest"), F.max("coef_error").alias("highest"), F.min_by("practical_score", order).alias("first_score"), F.sum("items").alias("items")))


@query(f"""WITH {RECORDS} SELECT system, method, sum(CASE WHEN items = 3 THEN 1 ELSE 0 END)::BIGINT AS exact_size, sum(CASE WHEN items = 3 AND support_f1 > 0.5 THEN 1 ELSE 0 END)::BIGINT AS exact_support, count(*) AS n FROM rec GROUP BY ALL""")
def rpt_selection_counts(spark, sf_dir):
    size, support = F.col("items") == 3, (F.col("items") == 3) & (F.col("support_f1") > 0.5)
    return records(spark, sf_dir).groupBy("system", "method").agg(F.sum(size.cast("int")).alias("exact_size"), F.sum(support.cast("int")).alias("exact_support"), F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, k AS (SELECT system, setting, noise, seed FROM rec GROUP BY ALL HAVING count(DISTINCT method) = 3), p AS (SELECT a.system, a.seed, a.method, a.coef_error - b.coef_error AS d FROM rec a JOIN rec b USING (system, setting, noise, seed) SEMI JOIN k USING (system, setting, noise, seed) WHERE a.method != 'N' AND b.method = 'N'),
c AS (SELECT method, seed, sum(d) AS s, count(d) AS c FROM p GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY method) / sum(c) OVER (PARTITION BY method) AS mean FROM c)
SELECT method, round(any_value(mean), 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(pow(s - c * mean, 2))) / sum(c) END, 6) AS clustered_se, count(*) AS clusters, sum(c)::BIGINT AS n FROM m GROUP BY method""")
def rpt_matched_controls(spark, sf_dir):
    matched = X.common_keys(records(spark, sf_dir), KEYS, "method", ["A", "N", "R"])
    pairs = R.paired(matched, KEYS, "method", "N", ["coef_error"])
    return rounded(R.clustered_se(pairs.withColumn("delta", F.col("coef_error") - F.col("coef_error_base")), ["method"], "seed", "delta"))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS first_word, len(string_split(p_type, ' '))::INT AS words, array_to_string(list_sort(string_split(p_type, ' ')), ';') AS sorted_words,
regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM part""")
def rec_text_lists(spark, sf_dir):
    """Words of a text as a list, joined in order, and a name made of what a file name may hold."""
    words, slug = F.split("p_type", " "), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", words[0].alias("first_word"), F.size(words).alias("words"), F.array_join(F.array_sort(words), ";").alias("sorted_words"), F.regexp_replace(slug, "^_|_$", "").alias("slug"))
