"""The supplied tables in the shapes that the operators take, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, t, x): each user's values by hours since the start of 2024."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(3600000000.0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("t"), F.col("value").alias("x"))


EVENTS = """ev AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 3600000000::DOUBLE AS t, value AS x FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, t, x): the mean value of each day, by days since the start of 2024."""
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").groupBy("event_type", d.cast("double").alias("t")).agg(F.avg("value").alias("x"))


DAILY = """dy AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS t, avg(value) AS x FROM events GROUP BY ALL)"""

KEYS = ["system", "setting", "noise", "seed"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each (system, method, setting, noise, seed), made of line items: region, return flag, priority, discount, line."""
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    nations = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 rows by definition
    placed = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "o_orderpriority", "r_name")
    j = li.select("l_orderkey", "l_returnflag", "l_discount", "l_linenumber", "l_quantity", "l_extendedprice").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("r_name").alias("system"), F.col("l_returnflag").alias("method"), F.col("o_orderpriority").alias("setting"), F.col("l_discount").alias("noise"), F.col("l_linenumber").alias("seed"))
    g = g.agg(F.round(F.avg("l_quantity") / 50, 12).alias("support_f1"), F.round(F.sqrt(F.avg("l_extendedprice")) / 300, 12).alias("coef_error"), F.count("*").alias("items"))
    return g.withColumn("practical_score", F.col("support_f1") / (1 + F.col("coef_error"))).withColumn("status", F.when(F.col("items") > 1, "ok").otherwise("fail: short"))


RECORDS = """rec0 AS (SELECT r_name AS system, l_returnflag AS method, o_orderpriority AS setting, l_discount AS noise, l_linenumber AS seed,
 round(avg(l_quantity) / 50, 12) AS support_f1, round(sqrt(avg(l_extendedprice)) / 300, 12) AS coef_error, count(*) AS items
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
rec AS (SELECT *, support_f1 / (1 + coef_error) AS practical_score, CASE WHEN items > 1 THEN 'ok' ELSE 'fail: short' END AS status FROM rec0)"""
