"""Whole jobs put together from the operators: features, ingestion, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import projections as pro
from ..operators import windows as win
from ..session import scratch_path
from ..sources import files, sinks
from ..sources.tables import MEETINGS, meetings, table
from ..streaming.ingest import ingest

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def with_form(df: DataFrame) -> DataFrame:
    return df.withColumn("form", F.round(win.rolling_full(F.col("home_score"), win.history(["home"], ["day", "id"]), 3), 6))


def with_rest(df: DataFrame) -> DataFrame:
    return df.withColumn("rest", F.date_diff("day", F.lag("day").over(win.history(["home"], ["day", "id"]))))


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", fn.three_way(F.col("home_score"), F.col("away_score")))


_W = "PARTITION BY home ORDER BY day, id"


@query(f"""SELECT id, CASE WHEN count(home_score) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN round(avg(home_score) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) END AS form,
  CAST(date_diff('day', lag(day) OVER ({_W}), day) AS INTEGER) AS rest, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' WHEN home_score < away_score THEN 'A' END AS label FROM {MEETINGS}""")
def feature_chain(spark, sf):
    """Feature stages, each a frame made wider; one that can't be built is left out."""
    df, _ = pro.run_stages(meetings(spark, sf), [("form", with_form), ("broken", lambda d: d.select("absent")), ("rest", with_rest), ("label", with_label)])
    return df.select("id", "form", "rest", "label")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS segment, n_name AS nation, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal * 2 ELSE c_acctbal END AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def ingestion_chain(spark, sf):
    """Source, normalisation, merge and store, with a correction that comes later."""
    root, target = scratch_path(spark, "ingestion"), scratch_path(spark, "ingested")
    table(spark, sf, "customer").withColumns({"grp": F.lit("c"), "period": F.lit("2024")}).write.partitionBy("grp", "period").option("header", True).csv(root)
    raw = files.numbers(files.read_csv_files(spark, root, [(("c_custkey",), {"c_mktsegment": "segment", "c_acctbal": "balance"})], ["c_custkey"], None, r"grp=([^/]+)/period=([^/]+)/[^/]+\.csv$"), ["balance"])
    raw = raw.withColumns({"c_custkey": F.col("c_custkey").cast("long"), "n_nationkey": F.col("c_nationkey").cast("int"), "segment": fn.canonical_name(F.col("segment"), {"BUILDING": "HOUSING"})})
    merged = raw.join(F.broadcast(table(spark, sf, "nation")), "n_nationkey").withColumn("nation", F.col("n_name"))
    columns = ["c_custkey", "segment", "nation", "balance"]
    sinks.store(merged, target, columns, ["c_custkey"])
    sinks.store(merged.where("segment = 'MACHINERY'").select("c_custkey", (F.col("balance") * 2).alias("balance")), target, columns, ["c_custkey"])
    return sinks.read_table(spark, target)


@query("""WITH b AS (SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_totalprice / 500000 AS p, 1.2 + (o_custkey % 30) / 10 AS odds, o_orderstatus = 'F' AS won FROM orders),
  s AS (SELECT *, least(0.25 * greatest((p * (odds - 1) - (1 - p)) / (odds - 1), 0), 0.03) AS stake FROM b WHERE p - 1 / odds >= 0.05)
  SELECT week, count(*) AS n, round(sum(stake), 6) AS staked, round(sum(CASE WHEN won THEN stake * (odds - 1) ELSE -stake END), 6) AS pnl FROM s GROUP BY week""")
def serving_chain(spark, sf):
    """Predictions, stakes, results and the weekly report."""
    o = table(spark, sf, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), (F.col("o_totalprice") / 500000).alias("p"), (1.2 + F.col("o_custkey") % 30 / 10).alias("odds"), (F.col("o_orderstatus") == "F").alias("won"))
    chosen = o.where(pro.closing_value(F.col("p"), F.col("odds")) >= 0.05).withColumn("stake", F.least(0.25 * fn.kelly(F.col("p"), F.col("odds")), F.lit(0.03)))
    gain = F.when(F.col("won"), F.col("stake") * (F.col("odds") - 1)).otherwise(-F.col("stake"))
    return chosen.groupBy("week").agg(F.count("*").alias("n"), F.round(F.sum("stake"), 6).alias("staked"), F.round(F.sum(gain), 6).alias("pnl"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def streamed_ingest(spark, sf):
    """Three loads from a folder that grows, the last of them late: files that were read are not read again, and
    rows that come late don't replace newer ones."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("stream-source", "stream-target", "stream-checkpoint"))
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    third = F.dayofmonth("ts") % 3
    for part in (e.where(third == 1), e.where(third == 2), e.where(third == 0)):
        part.write.mode("append").parquet(source)
        ingest(spark, source, e.schema.simpleString()[len("struct<") : -1].replace(":", " "), target, ["user_id"], ["ts", "event_id"], checkpoint)
    return sinks.read_table(spark, target).select("user_id", "event_id")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'customer', count(*) FROM customer")
def row_counts(spark, sf):
    """Rows of several tables; each count reads file footers only."""
    out = None
    for name in ("orders", "events", "customer"):
        one = table(spark, sf, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
