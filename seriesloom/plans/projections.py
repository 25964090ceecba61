"""Queries of projections, predicates, lookups, scalars and rolling metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as fn
from ..operators import metrics as met
from ..operators import projections as pro
from ..operators import windows as win
from ..session import dealt
from ..sources.tables import MEETINGS, meetings, table
from .evaluation import BETS, bets

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


NATIONS = "(SELECT c_nationkey AS k, count(*) AS n, round(sum(c_acctbal), 4) AS worth FROM customer GROUP BY 1)"


@query(f"SELECT m.id, h.n AS home_n, h.worth AS home_worth, a.n AS away_n, a.worth AS away_worth, round(h.worth / nullif(a.worth, 0), 6) AS ratio, h.n - a.n AS diff_n, round(h.worth - a.worth, 4) AS diff_worth, CAST(h.n AS BIGINT) * a.n AS home_n_x_away_n FROM {MEETINGS} m LEFT JOIN {NATIONS} h ON m.home = h.k LEFT JOIN {NATIONS} a ON m.away = a.k")
def both_sides_dimension(spark, sf):
    """A dimension beside both teams, ratio, differences of the pairs that are there, products."""
    dim = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("worth"))
    m = pro.both_sides(meetings(spark, sf).select("id", "home", "away"), dim, "k")
    m = m.withColumn("ratio", r6(fn.safe_divide(F.col("home_worth"), F.col("away_worth"))))
    m = pro.side_differences(m, pro.side_pairs(m, ["n", "worth"])).withColumn("diff_worth", F.round("diff_worth", 4))
    return pro.interactions(m, [("home_n", "away_n"), ("home_n", "absent")]).drop("home", "away")


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS first, CASE WHEN l_discount <> 0 THEN l_discount END AS positive, CASE WHEN l_linenumber < 5 THEN l_tax ELSE l_quantity END AS filled, l_tax AS share, 'l_tax,l_quantity' AS sources,
  CAST(NULL AS DOUBLE) AS stub, CAST(NULL AS DOUBLE) AS nothing FROM lineitem WHERE l_discount > 0""")
def resolved_columns(spark, sf):
    """Columns chosen by what the frame has; active rows; stubs; nothing where no candidate is there."""
    li = table(spark, sf, "lineitem").withColumn("text", F.when(F.col("l_linenumber") < 5, F.col("l_tax").cast("string")).otherwise("none"))
    chosen = pro.fallback_columns(li, {"tax": "l_tax", "price": "absent"}, {"tax": "l_discount", "price": "l_quantity"})
    li = pro.with_stubs(pro.active(pro.active(li, "l_discount"), "absent"), {"stub": "double", "l_tax": "double"}, "l_orderkey")
    li = pro.optional(li, {"share": "l_tax", "missing": "absent"})
    return li.select(
        "l_orderkey", "l_linenumber", pro.first_present(li, ["absent", "l_quantity", "l_tax"]).alias("first"), pro.first_present(li, ["l_discount"], True).alias("positive"), pro.coalesced(li, ["text", "l_quantity"]).alias("filled"),
        "share", F.lit(",".join(chosen[t] for t in ("tax", "price"))).alias("sources"), "stub", pro.first_present(li, ["absent"]).alias("nothing"),
    )


@query("""SELECT 'upcoming' AS part, o_orderkey FROM (SELECT *, CAST(o_orderdate AS DATE) = DATE '2000-06-15' AS same FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '2000-06-15') WHERE same OR NOT (SELECT bool_or(CAST(o_orderdate AS DATE) = DATE '2000-06-15') FROM orders)
  UNION ALL SELECT 'later', o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '2001-09-01'
  UNION ALL SELECT 'training', o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '2000-06-15' AND year(o_orderdate) >= 1999""")
def serving_predicates(spark, sf):
    """Rows of the day itself, rows to come where that day has none, and the rows to train on."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("target"))
    named = lambda df, part: df.select(F.lit(part).alias("part"), "o_orderkey")
    out = named(pro.upcoming(o, "target", "day", "2000-06-15"), "upcoming").unionByName(named(pro.upcoming(o, "target", "day", "2001-09-01"), "later"))
    return out.unionByName(named(pro.recent_training(o, "target", ["F", "O"], "day", "2000-06-15", "year"), "training"))


@query("SELECT 'l_extendedprice,l_quantity,l_tax' AS features, 'price,worth,extra' AS bases FROM region WHERE r_regionkey = 0")
def feature_selection(spark, sf):
    """Numeric columns that are not excluded and not mostly missing; bases that both sides have."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.lit(float("nan"))).alias("gone"), "l_tax", "l_returnflag", "l_suppkey")
    found = sorted(pro.feature_columns(li, ["l_suppkey"]))
    wide = spark.range(1).selectExpr("1 as home_price", "1 as away_price", "1 as home_worth", "1 as away_worth", "1 as home_alone", "1 as home_extra", "1 as away_extra")
    return spark.range(1).select(F.lit(",".join(found)).alias("features"), F.lit(",".join(pro.stat_bases(wide, ["price", "worth", "none"]))).alias("bases"))


SCAN = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1.5 + l_quantity / 10 AS b1, 4.0 - l_discount * 10 AS b2, 0.5 + l_linenumber / 10 AS p FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, market, book, round(price, 6) AS price, round(edge, 6) AS edge, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(edge, 6) DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, market) AS place FROM (
  SELECT *, 'x' AS market, CASE WHEN b2 > b1 AND b2 > 1 THEN 'b2' ELSE 'b1' END AS book, CASE WHEN b2 > b1 AND b2 > 1 THEN b2 ELSE b1 END AS price, p - 1 / CASE WHEN b2 > b1 AND b2 > 1 THEN b2 ELSE b1 END AS edge FROM {SCAN}
  UNION ALL SELECT *, 'y', 'b2', b2, 1 - p - 1 / b2 FROM {SCAN} WHERE b2 > 1) WHERE edge >= 0.31""")
def market_scan(spark, sf):
    """Best price of each market, rows of enough edge, ranked inside an order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (1.5 + F.col("l_quantity") / 10).alias("b1"), (4.0 - F.col("l_discount") * 10).alias("b2"), (0.5 + F.col("l_linenumber") / 10).alias("p"))
    m = pro.market_scan(li.withColumn("q", 1 - F.col("p")).withColumnRenamed("p", "own"), [("x", "own", ["b1", "b2"]), ("y", "q", ["b2"])], 0.31)
    m = m.withColumn("edge", r6("edge"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("edge"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "market"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "market", "book", r6("price").alias("price"), "edge", place.alias("place"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
  k AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM o WHERE n = 1), c AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
  SELECT c.o_custkey, c.o_orderpriority, k.o_orderkey AS last_key, t.n AS last_three FROM c LEFT JOIN k USING (o_custkey, o_orderpriority) JOIN (SELECT o_custkey, o_orderpriority, sum(o_orderkey) AS n FROM o WHERE n <= 3 GROUP BY ALL) t USING (o_custkey, o_orderpriority)""")
def key_lookups(spark, sf):
    """A lookup of two keys, of which the last row counts, joined as unique; the last three rows of each key."""
    o, key, order = table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]
    last = pro.one_per_key(o, key, order, last=True).select(*key, F.col("o_orderkey").alias("last_key"))
    three = pro.tail(o, key, order, 3).groupBy(*key).agg(F.sum("o_orderkey").alias("last_three"))
    return pro.unique_join(o.select(*key).distinct(), last, key).join(three, key)


ODDS = "(SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100000 END) AS sharp, max(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice / 90000 END) AS market FROM orders GROUP BY 1)"


@query(f"""WITH o AS (SELECT o_custkey, coalesce(sharp, market) AS price FROM {ODDS}), f AS (SELECT o_custkey, coalesce(price, median(price) OVER ()) AS price FROM o)
  SELECT c_custkey, round(price, 3) AS closing, price IS NOT NULL AS matched, round(0.5 - 1 / price, 6) AS value FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def closing_values(spark, sf):
    """Closing prices with fallbacks, and a probability's value against them."""
    state, price = F.col("o_orderstatus"), F.col("o_totalprice")
    odds = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(state == "F", price / 100000)).alias("sharp"), F.max(F.when((state == "O") & (F.col("o_orderpriority") == "1-URGENT"), price / 90000)).alias("market"))
    filled = pro.closing_prices(odds, ["sharp"], ["market"]).select("c_custkey", F.col("sharp").alias("closing"))
    c = pro.join_closing(table(spark, sf, "customer").select("c_custkey"), filled, ["c_custkey"])
    return c.select("c_custkey", F.round("closing", 3).alias("closing"), "matched", r6(pro.closing_value(F.lit(0.5), F.col("closing"))).alias("value"))


@query("""SELECT e.event_id, p.event_id AS result_id, e.value AS stake, CASE WHEN p.value > e.value THEN p.value - e.value ELSE -e.value END AS pnl FROM events e JOIN (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) p USING (user_id)
  WHERE e.event_type = 'click'""")
def settled_predictions(spark, sf):
    """Predictions with the result of their key; those without one drop out."""
    e = table(spark, sf, "events")
    result = pro.one_per_key(e.where("event_type = 'purchase'"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_id").alias("result_id"), F.col("value").alias("won"))
    s = e.where("event_type = 'click'").join(result, "user_id")
    return s.select("event_id", "result_id", F.col("value").alias("stake"), F.when(F.col("won") > F.col("value"), F.col("won") - F.col("value")).otherwise(-F.col("value")).alias("pnl"))


@query(f"""WITH d AS (SELECT day, sum(pnl) AS pnl FROM {BETS} GROUP BY 1), b AS (SELECT day, 1000 + coalesce(sum(pnl) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bank FROM d),
  w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, min(bank) FILTER (n = 1) AS opening FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY day) AS n FROM b) GROUP BY 1),
  r AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, pnl, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY pnl DESC) AS up, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY pnl) AS down FROM {BETS})
  SELECT week, round(opening, 4) AS opening, round(sum(pnl) FILTER (up <= 3), 4) AS best_three, round(sum(pnl) FILTER (down <= 3), 4) AS worst_three FROM w JOIN r USING (week) GROUP BY week, opening""")
def weekly_openings(spark, sf):
    """Bankroll before each week, and its three best and worst rows."""
    b = bets(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    weeks = b.groupBy("week").agg(F.sum("pnl").alias("pnl"))  # a row a week
    before = F.coalesce(F.sum("pnl").over(W.orderBy("week").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    three = lambda end: F.row_number().over(W.partitionBy("week").orderBy(end)) <= 3
    best = b.withColumn("in", three(F.desc("pnl"))).where("in").groupBy("week").agg(F.round(F.sum("pnl"), 4).alias("best_three"))
    worst = b.withColumn("in", three(F.asc("pnl"))).where("in").groupBy("week").agg(F.round(F.sum("pnl"), 4).alias("worst_three"))
    return weeks.select("week", F.round(1000 + before, 4).alias("opening")).join(best, "week").join(worst, "week")


@query("""SELECT user_id, count(*) FILTER (hour(ts) < 6) AS early, count(*) FILTER (hour(ts) >= 18) AS late, min(CAST(ts AS DATE)) AS first, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def timed_counts(spark, sf):
    """Only entities with such an event have a row."""
    hour = F.hour("ts")
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id").agg(F.count_if(hour < 6).alias("early"), F.count_if(hour >= 18).alias("late"), F.min(F.to_date("ts")).alias("first"), r6(F.avg("value")).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


FOLDS = "(SELECT year(o_orderdate) AS fold, o_orderpriority AS model, unnest(['a', 'b']) AS metric, unnest([CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, CAST(o_custkey AS DOUBLE)]) AS value FROM orders)"


@query(f"""WITH f AS (SELECT fold, model, metric, avg(value) AS value FROM {FOLDS} GROUP BY ALL), m AS (SELECT model, metric, avg(value) AS value FROM f GROUP BY ALL), h AS (SELECT arg_max(model, value) AS best FROM m WHERE metric = 'a')
  SELECT m.model, round(max(m.value) FILTER (metric = 'a'), 4) AS a, round(max(m.value) FILTER (metric = 'b'), 4) AS b, m.model = best AS leads, CASE WHEN max(m.value) FILTER (metric = 'a') > 252000 THEN 'green' WHEN max(m.value) FILTER (metric = 'a') > 249000 THEN 'amber' ELSE 'red' END AS light
  FROM m, h GROUP BY m.model, best""")
def model_comparison(spark, sf):
    """Metric means over folds, missing ones ignored; the leader and a traffic light for each model."""
    o = table(spark, sf, "orders")
    told = F.array(F.struct(F.lit("a").alias("metric"), F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice")).alias("value")), F.struct(F.lit("b").alias("metric"), F.col("o_custkey").cast("double").alias("value")))
    f = o.select(F.year("o_orderdate").alias("fold"), F.col("o_orderpriority").alias("model"), F.inline(told))
    f = f.groupBy("fold", "model", "metric").agg(F.avg(F.nanvl("value", F.lit(None).cast("double"))).alias("value"))
    m = f.groupBy("model").pivot("metric", ["a", "b"]).agg(F.avg("value"))
    best = F.broadcast(m.agg(F.max_by("model", "a").alias("best")))  # one row
    light = F.when(F.col("a") > 252000, "green").when(F.col("a") > 249000, "amber").otherwise("red")
    return m.crossJoin(best).select("model", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), (F.col("model") == F.col("best")).alias("leads"), light.alias("light"))


@query("SELECT event_type, round(avg(CAST(value IS NOT NULL AS INTEGER)), 6) AS filled FROM (SELECT event_type, CASE WHEN user_id > 20 THEN value END AS value FROM events) GROUP BY 1")
def fill_rates(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("user_id") > 20, F.col("value")).alias("value"))
    return e.groupBy("event_type").agg(r6(F.avg(F.col("value").isNotNull().cast("double"))).alias("filled"))


_P, _Y, _B = "(l_quantity / 50)", "CAST(l_returnflag = 'R' AS INTEGER)", "greatest(ceil(l_quantity / 50 * 10) - 1, 0)"
_LAST = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 49 PRECEDING AND CURRENT ROW"


@query(f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN count(*) OVER (w) = 50 THEN round(({" + ".join(f"abs(coalesce(sum(CASE WHEN {_B} = {b} THEN {_Y} - {_P} END) OVER (w), 0))" for b in range(10))}) / 50, 6) END AS ece FROM lineitem""".replace("OVER (w)", f"OVER ({_LAST})"))
def rolling_calibration(spark, sf):
    """Calibration error of the last 50 rows of each entity."""
    w = win.history(["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    e = met.rolling_ece(F.col("l_quantity") / 50, F.col("l_returnflag") == "R", w, 50)
    li = table(spark, sf, "lineitem")
    li = dealt(li, li.count(), "l_suppkey")  # counted from the files' footers
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r6(e).alias("ece"))


CUBE = "(SELECT o_orderpriority AS grp, year(o_orderdate) AS period, [o_totalprice / 500000, (1 - o_totalprice / 500000) * 0.7, (1 - o_totalprice / 500000) * 0.3] AS p, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders)"


@query(f"""WITH e AS (SELECT grp, period, unnest(p) AS p, unnest([0, 1, 2]) AS k, y FROM {CUBE}), b AS (SELECT grp, period, greatest(ceil(p * 10) - 1, 0) AS bin, count(*) AS n, abs(avg(p) - avg(CAST(k = y AS INTEGER))) AS gap FROM e GROUP BY ALL),
  c AS (SELECT grp, period, sum(n * gap) / sum(n) AS ece FROM b GROUP BY ALL)
  SELECT grp, period, round(ece, 6) AS ece, n, round(brier, 6) AS brier FROM c JOIN (SELECT grp, period, count(*) AS n, avg((p[1] - CAST(y = 0 AS INTEGER)) ** 2 + (p[2] - CAST(y = 1 AS INTEGER)) ** 2 + (p[3] - CAST(y = 2 AS INTEGER)) ** 2) AS brier FROM {CUBE} GROUP BY ALL) USING (grp, period)""")
def calibration_cube(spark, sf):
    """Calibration error, rows and Brier score of three classes for each group and year."""
    x = F.col("o_totalprice") / 500000
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("period"), F.array(x, (1 - x) * 0.7, (1 - x) * 0.3).alias("p"), y.alias("y"))
    return met.calibration_cube(o, "p", "y", ["grp", "period"]).select("grp", "period", r6("ece").alias("ece"), "n", r6("brier").alias("brier"))


@query(f"""WITH e AS (SELECT unnest(p) AS p, unnest([0, 1, 2]) AS k, y FROM {CUBE}), b AS (SELECT k, greatest(ceil(p * 15) - 1, 0) AS bin, count(*) AS n, abs(avg(p) - avg(CAST(k = y AS INTEGER))) AS gap FROM e GROUP BY ALL)
  SELECT round(avg(ece), 6) AS ece FROM (SELECT sum(n * gap) / sum(n) AS ece FROM b GROUP BY k)""")
def classwise_calibration(spark, sf):
    x = F.col("o_totalprice") / 500000
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = table(spark, sf, "orders").select(F.array(x, (1 - x) * 0.7, (1 - x) * 0.3).alias("p"), y.alias("y"))
    return met.classwise_ece(o, "p", "y").select(r6("ece").alias("ece"))


def _psi_sql(x: str) -> str:
    bins = f"SELECT least(floor(({x} - lo) / (hi - lo) * 10), 9) AS bin, CAST(NOT early AS INTEGER) AS late FROM d, (SELECT min({x}) AS lo, max({x}) AS hi FROM d WHERE early) WHERE {x} BETWEEN lo AND hi"
    share = lambda late: f"greatest(coalesce(count(b.bin) FILTER (late = {late}), 0) / (SELECT count(*) FROM ({bins}) WHERE late = {late}), 0.0001)"
    return f"SELECT '{x}' AS feature, sum((b - a) * ln(b / a)) AS psi FROM (SELECT g.bin, {share(0)} AS a, {share(1)} AS b FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN ({bins}) b USING (bin) GROUP BY g.bin)"


@query(f"""WITH d AS (SELECT l_quantity, l_extendedprice, l_shipdate < TIMESTAMP '1998-01-01' AS early FROM lineitem), r AS ({_psi_sql("l_quantity")} UNION ALL {_psi_sql("l_extendedprice")} UNION ALL SELECT 'moved', CAST('Infinity' AS DOUBLE) UNION ALL SELECT 'still', 0)
  SELECT feature, round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'alert' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END AS status FROM r""")
def drift_report(spark, sf):
    """Stability of several columns at once; two of them have no spread in the reference."""
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_shipdate", F.lit(1.0).alias("still"), F.when(early, 1.0).otherwise(2.0).alias("moved"))
    report = met.drift_report(li.where(early), li.where(~early), ["l_quantity", "l_extendedprice", "still", "moved"])
    return report.select("feature", r6("psi").alias("psi"), "status")


STAKES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 100 AS kelly, l_discount AS edge, 1.1 + l_tax * 60 AS odds FROM lineitem)"


@query(f"""WITH s AS (SELECT *, kelly * greatest(1 - 0.5 * greatest(edge - 0.05, 0) / 0.05, 0) * CASE WHEN odds < 1.2 OR odds > 5 THEN 0.5 ELSE 1 END AS shrunk FROM {STAKES})
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(shrunk, 9) AS shrunk, round(shrunk * least(1, 0.5 / sum(shrunk) OVER (PARTITION BY l_orderkey)), 9) AS scaled, CAST(l_linenumber % 3 AS INTEGER) AS phase FROM s""".replace("CAST(l_linenumber % 3 AS INTEGER)", "CASE WHEN l_linenumber * 5 <= 12 THEN 0 WHEN l_linenumber * 5 <= 26 THEN 1 ELSE 2 END"))
def shrunk_and_scaled(spark, sf):
    """Stakes that shrink with unbelievable edges and extreme odds, scaled to a budget; season phases."""
    li = table(spark, sf, "lineitem").withColumn("shrunk", F.col("l_quantity") / 100 * fn.edge_ramp(F.col("l_discount"), 1.1 + F.col("l_tax") * 60, 0.05))
    scaled = pro.budget_scaled(F.col("shrunk"), 0.5, F.sum("shrunk").over(W.partitionBy("l_orderkey")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("shrunk", 9).alias("shrunk"), F.round(scaled, 9).alias("scaled"), fn.round_phase(F.col("l_linenumber") * 5).alias("phase"))


@query(f"""SELECT id, k, round(p / (p0 + p1 + p2), 6) AS p, CAST(k = y AS INTEGER) AS hit, round([p0, p1, p2][y + 1] / (p0 + p1 + p2), 6) AS actual FROM (SELECT *, unnest([p0, p1, p2]) AS p, unnest([0, 1, 2]) AS k FROM (
  SELECT id, greatest(least(home_score / 30, 1), 1e-6) AS p0, greatest(least(away_score / 30, 1), 1e-6) AS p1, 1e-6 AS p2, CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS y FROM {MEETINGS}))""")
def class_rows(spark, sf):
    """Probabilities clipped and normalised, a row for each class, and that of the actual class."""
    h, a = F.col("home_score"), F.col("away_score")
    m = meetings(spark, sf).select("id", fn.normalised(F.array(h / 30, a / 30, F.lit(-1.0))).alias("p"), F.when(h > a, 0).when(h == a, 1).otherwise(2).alias("y"))
    m = m.withColumn("actual", pro.gathered(F.col("p"), F.col("y")))
    return pro.one_hot_rows(m, "p", "y").select("id", "k", r6("p").alias("p"), "hit", r6("actual").alias("actual"))


@query(f"SELECT id, label IN ('H', 'D') AS home_or_draw, label IN ('H', 'A') AS decided, least(home, away) || '_' || greatest(home, away) AS pair, CAST(day AS VARCHAR) || ' ' || home || '-' || away AS game, home_score - away_score AS over, coalesce(label, '?') AS told FROM (SELECT *, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' WHEN home_score < away_score THEN 'A' END AS label FROM {MEETINGS})".replace("least(home, away) || '_' || greatest(home, away)", "least(CAST(home AS VARCHAR), CAST(away AS VARCHAR)) || '_' || greatest(CAST(home AS VARCHAR), CAST(away AS VARCHAR))"))
def targets_and_keys(spark, sf):
    m = meetings(spark, sf).withColumn("label", fn.three_way(F.col("home_score"), F.col("away_score")))
    text = lambda c: F.col(c).cast("string")
    game = F.concat_ws(" ", text("day"), pro.composite_key(text("home"), text("away"), by="-"))
    return m.select("id", *pro.membership(F.col("label"), home_or_draw=["H", "D"], decided=["H", "A"]), pro.composite_key(text("home"), text("away"), unordered=True).alias("pair"), game.alias("game"), (F.col("home_score") - F.col("away_score")).alias("over"), F.coalesce("label", F.lit("?")).alias("told"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2024-05-01' WHEN 2 THEN '2024-05-01' END AS day, CASE p_partkey % 4 WHEN 0 THEN 'Aix-en-Y' WHEN 1 THEN 'X' WHEN 2 THEN 'q-r' END AS home, CASE p_partkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Aix-en-Y' WHEN 2 THEN 's' END AS away,
  CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 END AS defence, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 END AS midfield, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS attack,
  CASE p_partkey % 4 WHEN 0 THEN DATE '2024-05-03' WHEN 1 THEN DATE '2024-05-03' END AS date FROM part""")
def names_and_forms(spark, sf):
    """Game keys with hyphens in names, formations, and dates of several formats."""
    n = F.pmod(F.col("p_partkey"), F.lit(4))
    pick = lambda *x: F.when(n == 0, x[0]).when(n == 1, x[1]).when(n == 2, x[2]).otherwise(x[3])
    p = table(spark, sf, "part").select("p_partkey", pick("2024-05-01 Aix-en-Y-X", "2024-05-01 X-Aix-en-Y", "2024-05-01 q-r-s", "no key").alias("g"), pick("4-2-3-1 Attacking", " 5-3-2", "4-4", "none").alias("f"), pick("2024-05-03", "03/05/2024", "3rd May", "").alias("d"))
    key, form = pro.game_key(F.col("g"), ["Aix-en-Y", "X"]), fn.formation(F.col("f"))
    return p.select("p_partkey", *[key[c].alias(c) for c in ("day", "home", "away")], *[form[c].alias(c) for c in ("defence", "midfield", "attack")], fn.any_date(F.col("d"), "yyyy-MM-dd", "dd/MM/yyyy").alias("date"))


@query("""SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, 'alias of ' || n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'another' FROM nation WHERE n_regionkey = 1""")
def alias_rows(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    some = table(spark, sf, "nation").where("n_regionkey = 1")
    aliases = some.select(F.col("n_name").alias("name"), F.explode(F.array(F.concat(F.lit("alias of "), F.col("n_name")), F.lit("another"))).alias("alias"))
    return pro.aliased_rows(n, "n_name", aliases)


@query("""SELECT c_mktsegment AS feature, CASE c_mktsegment WHEN 'BUILDING' THEN 'leaker' WHEN 'MACHINERY' THEN 'suspicious' WHEN 'AUTOMOBILE' THEN 'suspicious' ELSE 'safe' END AS verdict, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 0.9 ELSE 0.1 END END AS correlation,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'spike; correlation' WHEN 'MACHINERY' THEN 'spike' WHEN 'AUTOMOBILE' THEN 'probe' ELSE '' END AS reasons FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def signal_verdicts(spark, sf):
    """Verdicts from three signals, of which one lacks a feature."""
    f = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("feature")).distinct()
    signal = lambda value, *flagged: f.select("feature", value.alias("value"), F.col("feature").isin(*flagged).alias("flagged"))
    correlation = F.when(F.col("feature") == "BUILDING", 0.9).otherwise(0.1)
    return pro.verdicts(signal(F.lit(1.0), "BUILDING", "MACHINERY"), signal(correlation, "BUILDING").where("feature <> 'AUTOMOBILE'"), signal(F.lit(1.0), "AUTOMOBILE"))


VENUE = "PARTITION BY home, season ORDER BY day, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"


@query(f"SELECT id, CASE WHEN count(home_score) OVER ({VENUE}) = 3 THEN round(avg(home_score) OVER ({VENUE}), 6) END AS form, round(avg(home_score) OVER ({VENUE}) - avg(away_score) OVER ({VENUE}), 6) AS margin FROM {MEETINGS}")
def venue_rolling(spark, sf):
    """Form from matches at the same venue only."""
    w = win.history(["home", "season"], ["day", "id"])
    m = meetings(spark, sf)
    return m.select("id", r6(win.rolling_full(F.col("home_score"), w, 3)).alias("form"), r6(win.rolling_any(F.col("home_score"), w, 3) - win.rolling_any(F.col("away_score"), w, 3)).alias("margin"))


@query("SELECT o_orderkey, least(floor(least(0.25 * f, 0.03) * 1000), 30) AS bucket FROM (SELECT o_orderkey, greatest(o_totalprice / 500000 - 0.5, 0) / 2 AS f FROM orders)")
def stake_distribution(spark, sf):
    f = F.greatest(F.col("o_totalprice") / 500000 - 0.5, F.lit(0.0)) / 2
    return table(spark, sf, "orders").select("o_orderkey", F.least(F.floor(F.least(0.25 * f, F.lit(0.03)) * 1000), F.lit(30)).alias("bucket"))


@query("SELECT e.event_id, e.value, p.value AS other FROM events e JOIN (SELECT event_id, value FROM events WHERE event_type = 'view') p ON e.event_id = p.event_id")
def row_key_join(spark, sf):
    """Frames put side by side by their row key."""
    e = table(spark, sf, "events")
    return e.select("event_id", "value").join(e.where("event_type = 'view'").select("event_id", F.col("value").alias("other")), "event_id")


@query("SELECT event_id, event_type, value, extra, batch FROM (SELECT event_id, event_type, value, NULL AS extra, 1 AS batch FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, NULL, value, user_id, 2 FROM events WHERE event_type = 'click')")
def widening_union(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type <> 'click'").select("event_id", "event_type", "value", F.lit(1).alias("batch"))
    return a.unionByName(e.where("event_type = 'click'").select("event_id", "value", F.col("user_id").alias("extra"), F.lit(2).alias("batch")), allowMissingColumns=True)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Saint Etienne' WHEN 1 THEN 'Besiktas JK' WHEN 2 THEN 'Málaga' WHEN 3 THEN 'Málaga' ELSE 'Unknown' END AS name,
  round(least(0.25 * least(k, 0.5 * k), 0.03), 6) AS stake FROM (SELECT p_partkey, greatest((p_size / 60 * 2 - (1 - p_size / 60)) / 2, 0) AS k FROM part)""")
def resolved_names(spark, sf):
    """Names by an explicit map, then by a list of known ones, with and without accents; a stake with a hook."""
    n = F.pmod(F.col("p_partkey"), F.lit(5))
    raw = F.when(n == 0, "Saint-Étienne").when(n == 1, " Beşiktaş ").when(n == 2, "Malaga").when(n == 3, "Málaga").otherwise("Unknown")
    name = fn.resolved_name(raw, {"Saint-Etienne": "Saint Etienne", "Beşiktaş": "Besiktas JK"}, ["Málaga", "Sevilla"])
    stake = fn.shrunk_stake(F.col("p_size") / 60, F.lit(3.0), F.lit(0.0), 1.0, hook=lambda f: 0.5 * f)
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), r6(stake).alias("stake"))
