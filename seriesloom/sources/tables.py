"""Table reads that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is null in every tenth, so that null guards are exercised."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return e.withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-sided row per order: home is the customer's nation, away the least supplier's."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.groupBy("l_orderkey").agg(F.min("s_nationkey").alias("away"), F.max("l_quantity").alias("home_score"), F.min("l_quantity").alias("away_score"))
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("home"), "away", "home_score", "away_score")


EVENTS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS value, props FROM events)"
MEETINGS = """(SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season, c_nationkey AS home, away, home_score, away_score
  FROM orders JOIN (SELECT l_orderkey, min(s_nationkey) AS away, max(l_quantity) AS home_score, min(l_quantity) AS away_score
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""
