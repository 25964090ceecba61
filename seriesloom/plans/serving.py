"""Queries of training tables, targets, ordered probes and the chain that serves."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import learning, metrics, projections, relations, serving, training
from ..session import scratch_path
from ..sources.tables import MEETINGS, meetings, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ROWS = f"""(SELECT id, day, season, home % 4 AS league, CASE WHEN id % 13 <> 0 THEN CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END END AS result,
  CASE WHEN id % 5 <> 0 THEN home_score END AS attack, CASE WHEN id % 3 = 0 THEN away_score END AS rare, CASE WHEN id % 7 <> 0 THEN home_score - away_score END AS gap, 1.5 AS odds FROM {MEETINGS})"""


@query(f"""WITH r AS (SELECT * FROM {ROWS} WHERE league IN (0, 1) AND season IN (1995, 1996, 1998) AND result IS NOT NULL)
  SELECT id, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS target, coalesce(attack, (SELECT median(attack) FROM r)) AS attack, coalesce(gap, (SELECT median(gap) FROM r)) AS gap, (SELECT avg(CAST(rare IS NULL AS INT)) <= 0.5 FROM r) AS has_rare FROM r""")
def training_rows(spark, sf):
    """Scan, filters, target, numeric columns that are half filled, and exact medians in their gaps."""
    m = meetings(spark, sf)
    i, h, a = F.col("id"), F.col("home_score"), F.col("away_score")
    rows = m.select(
        "id", "day", "season", (F.col("home") % 4).alias("league"), F.when(i % 13 != 0, F.when(h > a, "H").when(h == a, "D").otherwise("A")).alias("result"),
        F.when(i % 5 != 0, h).alias("attack"), F.when(i % 3 == 0, a).alias("rare"), F.when(i % 7 != 0, h - a).alias("gap"), F.lit(1.5).alias("odds"),
    )
    out, model = training.training_table(rows, "result", {"H": 0, "D": 1, "A": 2}, {"league": [0, 1], "season": [1995, 1996, 1998]}, ["id", "season", "league", "odds"], ["season", "day", "id"])
    return out.select("id", "target", "attack", "gap", F.lit("rare" in model.features).alias("has_rare"))


GOALS = f"(SELECT id, CASE WHEN id % 6 <> 0 THEN floor(home_score / 13) END AS h, CASE WHEN id % 10 <> 0 THEN floor(away_score / 9) END AS a, floor(home_score / 25) AS x, CASE WHEN id % 4 <> 0 THEN floor(away_score / 25) END AS y FROM {MEETINGS})"


@query(f"""SELECT id, CASE WHEN h > a THEN 'H' WHEN h = a THEN 'D' WHEN h < a THEN 'A' END AS result_1x2, CAST(h + a > 1.5 AS INT) AS over_1_5, CAST(h + a > 2.5 AS INT) AS over_2_5, CAST(h + a > 3.5 AS INT) AS over_3_5,
  CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN CAST(h > 0 AND a > 0 AS INT) END AS btts, CAST(h > 1.5 AS INT) AS home_goals_over_1_5, CAST(a > 0.5 AS INT) AS away_goals_over_0_5, CAST(h >= a AS INT) AS home_or_draw, CAST(h <> a AS INT) AS home_or_away, CAST(h <= a AS INT) AS draw_or_away,
  h - a AS margin, h + a AS total_goals, CASE WHEN x > y THEN 'H' WHEN x = y THEN 'D' WHEN x < y THEN 'A' END AS ht_result_1x2, CAST(x + y > 0.5 AS INT) AS ht_over_0_5 FROM {GOALS}""")
def target_bundle(spark, sf):
    """Twelve targets and two of the first half, null where a score is missing."""
    i = F.col("id")
    m = meetings(spark, sf).select(
        "id", F.when(i % 6 != 0, F.floor(F.col("home_score") / 13)).cast("double").alias("home_goals"), F.when(i % 10 != 0, F.floor(F.col("away_score") / 9)).cast("double").alias("away_goals"),
        F.floor(F.col("home_score") / 25).alias("x"), F.when(i % 4 != 0, F.floor(F.col("away_score") / 25)).alias("y"),
    )
    return training.with_targets(m, half=("x", "y")).drop("home_goals", "away_goals", "x", "y")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_custkey % 50 AS k, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS probe FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
  SELECT o_orderkey, arg_min(probe, CASE off WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 WHEN 2 THEN 4 END) AS probe FROM (SELECT o_orderkey, probe, date_diff('day', l.d, r.d) AS off FROM l LEFT JOIN r ON k = o_custkey % 50 AND r.d BETWEEN l.d - 2 AND l.d + 2) GROUP BY 1""")
def ordered_probes(spark, sf):
    """The same day, else the day before, the day after, two before, two after; of one day the last row."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), "o_orderdate", "o_orderstatus")
    right = o.where("o_orderstatus = 'F'").select("k", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("probe"))
    out = relations.probed_join(o.where("o_orderstatus = 'O'"), right, ["k"], "o_orderdate", "at", 2, ["o_orderkey"], ["probe"])
    return out.select("o_orderkey", "probe")


CANDIDATES = f"""(SELECT id AS match_id, day, 'home' AS market, home % 4 AS league, 0.30 + home_score / 120 AS p, 1.5 + away_score / 25 AS odds FROM {MEETINGS}
  UNION ALL SELECT id, day, 'away', home % 4, 0.15 + away_score / 110, 1.9 + home_score / 40 FROM {MEETINGS})"""


@query(f"""WITH b AS (SELECT *, least(0.25 * greatest((p * (odds - 1) - (1 - p)) / (odds - 1), 0), 0.03) * 1000 AS stake FROM {CANDIDATES} WHERE p - 1 / odds >= 0.05),
  s AS (SELECT b.*, CAST(date_trunc('week', b.day) AS DATE) AS week, market = CASE WHEN home_score > away_score + 20 THEN 'home' ELSE 'away' END AS hit, CASE WHEN id % 4 <> 0 THEN 1 + id % 9 / 4.0 END AS closing FROM b JOIN {MEETINGS} m ON m.id = match_id WHERE id % 10 <> 0),
  t AS (SELECT *, round(stake, 2) AS staked, round(CASE WHEN hit THEN stake * (odds - 1) ELSE -stake END, 2) AS pnl, round(p - CASE WHEN closing > 1 THEN 1 / closing END, 6) AS clv,
    row_number() OVER (PARTITION BY week ORDER BY round(CASE WHEN hit THEN stake * (odds - 1) ELSE -stake END, 2) DESC, match_id, market) AS best, row_number() OVER (PARTITION BY week ORDER BY round(CASE WHEN hit THEN stake * (odds - 1) ELSE -stake END, 2), match_id, market) AS worst FROM s),
  l AS (SELECT week, string_agg(x, ' ' ORDER BY x) AS by_league FROM (SELECT week, league || '=' || count(*) || '/' || printf('%.2f', round(sum(pnl), 2)) AS x FROM t GROUP BY week, league) GROUP BY week),
  k AS (SELECT week, string_agg(x, ' ' ORDER BY x) AS by_market FROM (SELECT week, market || '=' || count(*) || '/' || printf('%.2f', round(sum(pnl), 2)) AS x FROM t GROUP BY week, market) GROUP BY week),
  w AS (SELECT week, count(*) AS bets, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS wins, round(sum(pnl), 2) AS pnl, sum(staked) AS staked, coalesce(avg(clv), 0) AS clv, string_agg(match_id || ':' || market, ' ' ORDER BY best) FILTER (best <= 3) AS best, string_agg(match_id || ':' || market, ' ' ORDER BY worst) FILTER (worst <= 3) AS worst FROM t GROUP BY week)
  SELECT week, bets, wins, bets - wins AS losses, pnl, round(clv, 6) AS clv, round(pnl / staked, 6) AS roi, round(1000 + coalesce(sum(pnl) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS bankroll_start,
    round(round(1000 + coalesce(sum(pnl) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) + pnl, 2) AS bankroll_end, best, worst, by_league, by_market FROM w JOIN l USING (week) JOIN k USING (week)""")
def served_weeks(spark, sf):
    """Recommendations saved in two parts and once more, results that come in two parts, and the weekly report of what is settled."""
    m = meetings(spark, sf)
    h, a = F.col("home_score"), F.col("away_score")
    bet = lambda market, p, odds: m.select(F.col("id").alias("match_id"), "day", F.lit(market).alias("market"), (F.col("home") % 4).alias("league"), F.lit(None).cast("int").alias("round"), "home", "away", p.alias("p"), odds.alias("odds"))
    candidates = bet("home", 0.30 + h / 120, 1.5 + a / 25).unionByName(bet("away", 0.15 + a / 110, 1.9 + h / 40))
    bets = serving.recommendations(candidates, 0.05, per_league=1e9, per_team=1e9)
    book = serving.Book(spark, scratch_path(spark, "book"))
    early = F.col("day") < F.lit("1998-01-01").cast("date")
    book.save(bets.where(early))
    closing = F.when(F.col("id") % 4 != 0, 1 + F.col("id") % 9 / 4)
    results = m.where("id % 10 <> 0").select(F.col("id").alias("match_id"), F.when(h > a + 20, "H").otherwise("A").alias("result"), closing.alias("closing"), "day")
    wins = {"home": "H", "away": "A"}
    book.settle(results.where(early & (F.col("match_id") % 2 == 0)), wins)
    book.save(bets)
    book.settle(results, wins)
    return book.weekly().select("week", "bets", "wins", "losses", "pnl", F.round("clv", 6).alias("clv"), F.round("roi", 6).alias("roi"), "bankroll_start", "bankroll_end", "best", "worst", "by_league", "by_market")


@query()
def boosted_trees(spark, sf):
    """Accuracy and log loss of boosted trees of three classes on the last fifth of the orders, stopped early by a part of the others."""
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.count("*").alias("c")), "o_orderkey")
    label = F.when(F.col("a") * F.col("b") > 1.5, 0.0).when(F.col("c") > 4, 1.0).otherwise(2.0)
    rows = o.select("o_orderkey", "o_orderdate", "a", "b", "c", label.alias("label"), (F.col("o_orderkey") % 5 == 0).alias("held"))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(learning.ranked(rows, ["o_orderdate", "o_orderkey"]))
    bar = rows.count() * 0.8
    model = learning.create_model("boosted", trees=20, depth=3, validation="held", tolerance=0.01).fit(rows.where(F.col("__i") < bar))
    told = model.transform(rows.where(F.col("__i") >= bar)).withColumn("p", vector_to_array("probability"))
    return told.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), metrics.log_loss(projections.gathered(F.col("p"), F.col("label").cast("int"))).alias("log_loss"))


SETTLED = """(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 < 3 AS hit, CASE WHEN o_orderkey % 7 < 3 THEN o_totalprice / 100000 ELSE -10.0 END AS pnl, 10.0 AS staked, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice / 1000000 - 0.2 END AS clv FROM orders)"""


def settled_orders(spark, sf):
    won = F.col("o_orderkey") % 7 < 3
    return table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), won.alias("hit"), F.when(won, F.col("o_totalprice") / 100000).otherwise(-10.0).alias("pnl"), F.lit(10.0).alias("staked"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice") / 1000000 - 0.2).alias("clv")
    )


@query(f"""WITH s AS (SELECT *, 100000 + sum(pnl) OVER w AS bank, row_number() OVER w AS i FROM {SETTLED} WINDOW w AS (ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(100000, max(bank) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS peak FROM s),
  e AS (SELECT arg_max(hit, i) AS last, max(i) AS n FROM s)
  SELECT count(*) AS bets, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS wins, CAST(count(*) - sum(CAST(hit AS INT)) AS BIGINT) AS losses, round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(sum(pnl), 2) AS pnl, round(sum(pnl) / sum(staked), 6) AS roi, round(avg(clv), 6) AS mean_clv, round(100000 + sum(pnl), 2) AS bankroll,
    round(max(CASE WHEN peak > 0 THEN (peak - bank) / peak END), 6) AS max_drawdown, (SELECT CAST(CASE WHEN last THEN 1 ELSE -1 END * (n - coalesce((SELECT max(i) FROM s WHERE hit <> last), 0)) AS BIGINT) FROM e) AS streak FROM p""")
def running_report(spark, sf):
    """All totals of settled bets in one row."""
    t = serving.running_totals(settled_orders(spark, sf), ["o_orderkey"], 100_000.0)
    return t.select("bets", "wins", "losses", *[F.round(c, 6).alias(c) for c in ("hit_rate", "roi", "mean_clv", "max_drawdown")], "pnl", "bankroll", "streak")


@query(f"""SELECT strftime(day, '%Y-%m') AS month, count(*) AS bets, round(avg(CAST(hit AS INT)), 6) AS win_rate, round(100 * sum(pnl) / sum(staked), 6) AS roi_pct, round(sum(pnl), 2) AS profit FROM {SETTLED} GROUP BY 1""")
def monthly_breakdown(spark, sf):
    b = serving.breakdown(settled_orders(spark, sf), F.date_format("day", "yyyy-MM"), "month")
    return b.select("month", "bets", *[F.round(c, 6).alias(c) for c in ("win_rate", "roi_pct")], "profit")
