"""Queries over entity histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import windows as ops
from ..sources.tables import EVENTS, MEETINGS, events, meetings, table

QUERIES, SQL = {}, {}
BY, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]
WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
X = "o_totalprice"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


def full(n: int, x: str = "o_totalprice", win: str = WIN) -> str:
    return f"CASE WHEN count({x}) OVER ({win} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg({x}) OVER ({win} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


@query(f"""SELECT o_orderkey, round({full(3)}, 6) AS form3, round({full(5)}, 6) AS form5, round({full(10)}, 6) AS form10,
  round(avg(o_totalprice) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS so_far FROM orders""")
def rolling_form(spark, sf):
    w = ops.history(BY, ORDER)
    return orders(spark, sf).select("o_orderkey", *[r6(ops.rolling_full(F.col(X), w, n)).alias(f"form{n}") for n in (3, 5, 10)], r6(ops.expanding(F.col(X), w)).alias("so_far"))


EV = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""SELECT event_id, round(coalesce(avg(value) OVER ({EV} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 6) AS mean5,
  round(last_value(s IGNORE NULLS) OVER ({EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS sum2
  FROM (SELECT *, sum(value) OVER ({EV} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS s FROM {EVENTS})""")
def rolling_any_filled(spark, sf):
    w = ops.history(["user_id"], ["ts", "event_id"])
    e = events(spark, sf).withColumn("s", ops.rolling_any(F.col("value"), w, 2, F.sum))
    return e.select("event_id", r6(F.coalesce(ops.rolling_any(F.col("value"), w, 5), F.lit(0.0))).alias("mean5"), r6(ops.filled(F.col("s"), w)).alias("sum2"))


@query(f"""SELECT o_orderkey, l1, l2, l3, round(l1 - l5, 6) AS lag_diff, round(f3 - f10, 6) AS momentum,
  round({full(5, "step")}, 6) AS diff_form
  FROM (SELECT *, o_totalprice - lag(o_totalprice) OVER ({WIN}) AS step, lag(o_totalprice, 1) OVER ({WIN}) AS l1, lag(o_totalprice, 2) OVER ({WIN}) AS l2,
    lag(o_totalprice, 3) OVER ({WIN}) AS l3, lag(o_totalprice, 5) OVER ({WIN}) AS l5, {full(3)} AS f3, {full(10)} AS f10 FROM orders)""")
def lag_family(spark, sf):
    w = ops.history(BY, ORDER)
    o = ops.difference_form(orders(spark, sf), "o_totalprice", w, 5, "diff_form")
    lags = [F.lag(X, k).over(w).alias(f"l{k}") for k in (1, 2, 3)]
    return o.select("o_orderkey", *lags, r6(ops.lag_difference(F.col(X), w, 5)).alias("lag_diff"), r6(ops.rolling_full(F.col(X), w, 3) - ops.rolling_full(F.col(X), w, 10)).alias("momentum"), r6("diff_form").alias("diff_form"))


STREAK = f"""SELECT *, lag(run) OVER ({EV}) AS streak FROM (
    SELECT *, sum(f) OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS run FROM (
      SELECT *, sum(1 - f) OVER ({EV}) AS b FROM (SELECT *, CASE WHEN value > 30 THEN 1 ELSE 0 END AS f FROM {EVENTS})))"""


@query(f"SELECT event_id, CAST(streak AS BIGINT) AS streak, CAST(coalesce(streak, 0) AS BIGINT) AS streak0 FROM ({STREAK})")
def streaks(spark, sf):
    return ops.streaks(events(spark, sf), F.col("value") > 30, ["user_id"], ["ts", "event_id"]).select("event_id", "streak", "streak0")


@query(f"""WITH a AS (SELECT event_id, user_id, ts, value > 30 AS g, row_number() OVER ({EV}) AS n FROM {EVENTS} WHERE value IS NOT NULL),
  b AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, g ORDER BY n) AS i FROM a),
  c AS (SELECT user_id, g, i, count(*) AS len, max(n) AS last_n FROM b GROUP BY ALL)
  SELECT user_id, coalesce(max(CASE WHEN g THEN len END), 0) AS longest_true, coalesce(max(CASE WHEN NOT g THEN len END), 0) AS longest_false,
    arg_max(CASE WHEN g THEN len ELSE -len END, last_n) AS tail FROM c GROUP BY user_id""")
def run_lengths(spark, sf):
    e = events(spark, sf).where("value is not null")
    return ops.run_summary(e, F.col("value") > 30, ["user_id"], ["ts", "event_id"])


@query("""SELECT o_orderkey,
  count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last30,
  count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last90,
  CAST(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), CAST(o_orderdate AS DATE)) AS INTEGER) AS days_since FROM orders""")
def range_counts(spark, sf):
    day = F.to_date("o_orderdate")
    since = F.datediff(day, F.lag(day).over(ops.history(BY, ORDER)))
    return orders(spark, sf).select("o_orderkey", ops.range_count(BY, day, 30).alias("last30"), ops.range_count(BY, day, 90).alias("last90"), since.alias("days_since"))


@query("""SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS own_so_far,
  round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS urgent_so_far FROM orders""")
def conditional_expanding(spark, sf):
    own = ops.expanding(F.col(X), ops.history([*BY, "o_orderpriority"], ORDER))
    urgent = ops.expanding(F.when(F.col("o_orderpriority") == "1-URGENT", F.col(X)), ops.history(BY, ORDER))
    return orders(spark, sf).select("o_orderkey", r6(own).alias("own_so_far"), r6(urgent).alias("urgent_so_far"))


@query("""SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS pct,
  round(CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY p_brand) - 1) END, 6) AS score FROM part""")
def percentile_ranks(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", r6(ops.percentile_rank(size, ["p_brand"])).alias("pct"), r6(ops.rank_score(size, ["p_brand"])).alias("score"))


@query(f"""SELECT event_id, round(CASE WHEN row_number() OVER ({EV}) > 4 THEN (coalesce(CAST(lag(event_type, 1) OVER ({EV}) = event_type AS INTEGER), 0) + coalesce(CAST(lag(event_type, 2) OVER ({EV}) = event_type AS INTEGER), 0)
  + coalesce(CAST(lag(event_type, 3) OVER ({EV}) = event_type AS INTEGER), 0) + coalesce(CAST(lag(event_type, 4) OVER ({EV}) = event_type AS INTEGER), 0)) / 4.0 END, 6) AS same4 FROM events""")
def match_ratio(spark, sf):
    w = ops.history(["user_id"], ["ts", "event_id"])
    return table(spark, sf, "events").select("event_id", r6(ops.same_share(F.col("event_type"), w, 4)).alias("same4"))


@query("""SELECT o_custkey, o_orderkey, o_orderpriority, round(before, 2) AS before FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY before DESC NULLS LAST, o_orderdate, o_orderkey) AS n FROM (
  SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders)) WHERE n = 1""")
def leader_before(spark, sf):
    return ops.leader_before(orders(spark, sf), BY, "o_orderpriority", "o_totalprice", ORDER).select("o_custkey", "o_orderkey", "o_orderpriority", F.round("before", 2).alias("before"))


@query(f"""SELECT event_id, round(equity, 4) AS equity, round(peak, 4) AS peak, round(CASE WHEN peak > 0 THEN (peak - equity) / peak END, 6) AS drawdown, round(100 * exp(lg), 4) AS bankroll FROM (
  SELECT *, max(equity) OVER ({EV}) AS peak FROM (SELECT event_id, user_id, ts, sum(g) OVER ({EV}) AS equity, sum(ln(1 + g / 10000)) OVER ({EV}) AS lg
    FROM (SELECT *, coalesce(value, 20) - 20 AS g FROM {EVENTS})))""")
def equity_curves(spark, sf):
    g = F.coalesce("value", F.lit(20.0)) - 20
    e = ops.drawdowns(events(spark, sf), g, ["user_id"], ["ts", "event_id"])
    bank = ops.running_product(g / 10000, ops.history(["user_id"], ["ts", "event_id"]), 100.0)
    return e.select("event_id", F.round("equity", 4).alias("equity"), F.round("peak", 4).alias("peak"), r6("drawdown").alias("drawdown"), F.round(bank, 4).alias("bankroll"))


@query(f"""SELECT user_id, round(max(CASE WHEN peak > 0 THEN (peak - equity) / peak END), 6) AS by_running_peak, round(max(peak - equity) / nullif(max(peak), 0), 6) AS by_global_peak FROM (
  SELECT *, max(equity) OVER ({EV}) AS peak FROM (SELECT *, sum(coalesce(value, 20) - 20) OVER ({EV}) AS equity FROM {EVENTS})) GROUP BY user_id""")
def max_drawdowns(spark, sf):
    e = ops.drawdowns(events(spark, sf), F.coalesce("value", F.lit(20.0)) - 20, ["user_id"], ["ts", "event_id"])
    most = F.max("peak")
    return e.groupBy("user_id").agg(r6(F.max("drawdown")).alias("by_running_peak"), r6(F.max(F.col("peak") - F.col("equity")) / F.nullif(most, F.lit(0.0))).alias("by_global_peak"))


PAIR = "PARTITION BY least(home, away), greatest(home, away) ORDER BY day, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING"


@query(f"""SELECT id, count(*) OVER ({PAIR}) AS met, round(avg(home_score + away_score) OVER ({PAIR}), 6) AS total,
  round(CASE WHEN home <= away THEN avg(low) OVER ({PAIR}) ELSE -avg(low) OVER ({PAIR}) END, 6) AS margin
  FROM (SELECT *, CASE WHEN home <= away THEN home_score - away_score ELSE away_score - home_score END AS low FROM {MEETINGS})""")
def last_meetings(spark, sf):
    """The last five meetings of an unordered pair, seen from today's home side."""
    m = meetings(spark, sf).withColumn("a", F.least("home", "away")).withColumn("b", F.greatest("home", "away"))
    first = F.col("home") <= F.col("away")
    m = m.withColumn("low", F.when(first, F.col("home_score") - F.col("away_score")).otherwise(F.col("away_score") - F.col("home_score")))
    w = W.partitionBy("a", "b").orderBy("day", "id").rowsBetween(-5, -1)
    low = F.avg("low").over(w)
    return m.select("id", F.count("*").over(w).alias("met"), r6(F.avg(F.col("home_score") + F.col("away_score")).over(w)).alias("total"), r6(F.when(first, low).otherwise(-low)).alias("margin"))


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER (w) = 20 THEN avg(value) OVER (w) END, 6) AS mean20 FROM {EVENTS} WINDOW w AS ({EV} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)".replace("OVER (w)", "OVER w"))
def rolling_here(spark, sf):
    return events(spark, sf).select("event_id", r6(ops.rolling_here(F.col("value"), ops.history(["user_id"], ["ts", "event_id"]), 20)).alias("mean20"))
