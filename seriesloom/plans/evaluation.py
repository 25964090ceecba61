"""Queries of aggregations, metrics, calendars, stakes and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as fn
from ..operators import metrics as met
from ..operators import portfolio, stateful
from ..operators import relations as rel
from ..operators.selection import exact_quantiles
from ..session import materialised
from ..sources.tables import MEETINGS, meetings, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS accepted_final,
  round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0), 2) AS returned_price, round(sum(CASE WHEN l_quantity > 49 THEN l_discount END), 6) AS big_discount,
  round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS open_quantity, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS coverage FROM lineitem GROUP BY l_suppkey""")
def conditional_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    back = F.col("l_returnflag") == "R"
    return li.groupBy("l_suppkey").agg(
        F.count_if(back).alias("returned"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("accepted_final"),
        F.round(F.coalesce(F.sum(F.when(back, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("returned_price"),
        r6(F.sum(F.when(F.col("l_quantity") > 49, F.col("l_discount")))).alias("big_discount"),
        r6(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")))).alias("open_quantity"), r6(F.count_if(back) / F.count("*")).alias("coverage"),
    )


@query("""SELECT p_brand, round(avg(p_retailprice), 6) AS mean, max(p_retailprice) AS most, min(p_retailprice) AS least, round(stddev_samp(p_retailprice), 6) AS sd, count(*) FILTER (p_size > 25) AS large,
  round(avg(CASE WHEN p_type = 'ECONOMY' THEN p_size END), 6) AS economy_size FROM part GROUP BY p_brand""")
def group_profile(spark, sf):
    x = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(
        r6(F.avg(x)).alias("mean"), F.max(x).alias("most"), F.min(x).alias("least"), r6(F.stddev_samp(x)).alias("sd"), F.count_if(F.col("p_size") > 25).alias("large"),
        r6(F.avg(F.when(F.col("p_type") == "ECONOMY", F.col("p_size")))).alias("economy_size"),
    )


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def crosstab(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


SCORED = "(SELECT l_suppkey, l_quantity / 50 AS p, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"


def scored(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query(f"""SELECT l_suppkey, round(sum(n * abs(predicted - observed)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT l_suppkey, greatest(ceil(p * 10) - 1, 0) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM {SCORED} GROUP BY ALL) GROUP BY l_suppkey""")
def calibration_error(spark, sf):
    return met.ece(scored(spark, sf), F.col("p"), F.col("y"), ["l_suppkey"]).select("l_suppkey", r6("ece").alias("ece"), "n")


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM {SCORED} GROUP BY ALL")
def reliability(spark, sf):
    r = met.reliability(scored(spark, sf), F.col("p"), F.col("y"))
    return r.select("bin", "n", r6("predicted").alias("predicted"), r6("observed").alias("observed"))


@query(f"SELECT l_suppkey, round(avg(-ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1 - 1e-15), 1e-15))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier FROM {SCORED} GROUP BY l_suppkey")
def probability_scores(spark, sf):
    p, y = F.col("p"), F.col("y")
    return scored(spark, sf).groupBy("l_suppkey").agg(r6(met.log_loss(F.when(y == 1, p).otherwise(1 - p))).alias("log_loss"), r6(met.brier(p, y)).alias("brier"))


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
  b AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS ref, CAST(least(floor((o_totalprice - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin FROM orders, e WHERE o_totalprice BETWEEN lo AND hi),
  c AS (SELECT i AS bin, (SELECT count(*) FROM b WHERE ref AND b.bin = i) AS a, (SELECT count(*) FROM b WHERE NOT ref AND b.bin = i) AS c FROM range(10) t(i)),
  s AS (SELECT greatest(a / sum(a) OVER (), 1e-4) AS pa, greatest(c / sum(c) OVER (), 1e-4) AS pb FROM c)
  SELECT round(sum((pb - pa) * ln(pb / pa)), 6) AS psi FROM s""")
def population_stability(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", "o_orderdate")
    first = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    return met.psi(o.where(first), o.where(~first), "o_totalprice").select(r6("psi").alias("psi"))


@query("""SELECT 'l_quantity' AS feature, round(greatest(abs(corr(l_quantity, CAST(l_returnflag = 'A' AS INTEGER))), abs(corr(l_quantity, CAST(l_returnflag = 'N' AS INTEGER))), abs(corr(l_quantity, CAST(l_returnflag = 'R' AS INTEGER)))), 6) AS correlation FROM lineitem
  UNION ALL SELECT 'l_discount', round(greatest(abs(corr(l_discount, CAST(l_returnflag = 'A' AS INTEGER))), abs(corr(l_discount, CAST(l_returnflag = 'N' AS INTEGER))), abs(corr(l_discount, CAST(l_returnflag = 'R' AS INTEGER)))), 6) FROM lineitem""")
def class_correlation(spark, sf):
    c = met.class_correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag", ["A", "N", "R"])
    return c.select("feature", r6("correlation").alias("correlation"))


BETS = "(SELECT o_orderpriority AS market, o_custkey, CAST(o_orderdate AS DATE) AS day, 10.0 AS stake, CASE WHEN o_orderkey % 3 = 0 THEN 10 * (o_totalprice / 199999.7) ELSE -10.0 END AS pnl FROM orders)"


def bets(spark, sf):
    win = F.col("o_orderkey") % 3 == 0
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("market"), "o_custkey", F.to_date("o_orderdate").alias("day"), F.lit(10.0).alias("stake"), F.when(win, 10 * (F.col("o_totalprice") / 199999.7)).otherwise(-10.0).alias("pnl"))


@query(f"SELECT market, count(*) AS n, CAST(sum(stake) AS DOUBLE) AS staked, round(sum(pnl) / sum(stake), 6) AS roi, round(avg(CAST(pnl > 0 AS INTEGER)), 6) AS hit_rate, round(avg(pnl) / stddev_samp(pnl), 6) AS sharpe FROM {BETS} GROUP BY market")
def betting_summary(spark, sf):
    return met.betting_summary(bets(spark, sf), F.col("stake"), F.col("pnl"), ["market"]).select("market", "n", "staked", *[r6(c).alias(c) for c in ("roi", "hit_rate", "sharpe")])


@query(f"SELECT market, count(pnl) AS n, round(avg(pnl), 6) AS mean, round(median(pnl), 6) AS median, round(stddev_samp(pnl), 6) AS sd, round(avg(CAST(pnl > 0 AS INTEGER)), 6) AS positive, round(avg(pnl) - 1.96 * stddev_samp(pnl) / sqrt(count(pnl)), 6) AS low, round(avg(pnl) + 1.96 * stddev_samp(pnl) / sqrt(count(pnl)), 6) AS high FROM {BETS} GROUP BY market")
def edge_summary(spark, sf):
    s = met.edge_summary(bets(spark, sf), F.col("pnl"), ["market"])
    return s.select("market", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "positive", "low", "high")])


@query(f"SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, round(sum(pnl), 4) AS pnl, round(sum(pnl) / sum(stake), 6) AS roi FROM {BETS} GROUP BY 1")
def weekly_rollup(spark, sf):
    week = F.to_date(F.date_trunc("week", "day"))
    return bets(spark, sf).groupBy(week.alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), r6(F.sum("pnl") / F.sum("stake")).alias("roi"))


@query(f"SELECT strftime(day, '%Y-%m') AS month, market, count(*) AS n, round(sum(pnl), 4) AS pnl FROM {BETS} GROUP BY GROUPING SETS ((strftime(day, '%Y-%m')), (market))")
def monthly_and_market(spark, sf):
    """Both single-key roll-ups in one pass."""
    b = bets(spark, sf).withColumn("month", F.date_format("day", "yyyy-MM"))
    sets = b.groupingSets([["month"], ["market"]], "month", "market")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query(f"""SELECT d AS day, coalesce(n, 0) AS n, round(coalesce(pnl, 0), 4) AS pnl, round(sum(coalesce(pnl, 0)) OVER (ORDER BY d), 4) AS equity
  FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders) LEFT JOIN (SELECT day, count(*) AS n, sum(pnl) AS pnl FROM {BETS} GROUP BY day) ON day = d""")
def calendar_fill(spark, sf):
    """Daily buckets with empty days, and their running total (one row a day)."""
    daily = bets(spark, sf).groupBy("day").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    first, last = daily.agg(F.min("day"), F.max("day")).first()
    d = rel.calendar(daily, "day", str(first), str(last)).na.fill(0)
    total = F.sum("pnl").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return d.select("day", "n", F.round("pnl", 4).alias("pnl"), F.round(total, 4).alias("equity"))


@query("(SELECT 'top' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3)")
def top_and_bottom(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.lit("top").alias("part"), "*")
    return top.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(3).select(F.lit("bottom").alias("part"), "*"))


LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, 1.5 + l_quantity / 10 AS o1, CASE WHEN l_linenumber <> 3 THEN 3 + l_discount END AS o2, 2.0 + l_tax AS o3, l_discount * 5 AS p FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / o1 + 1 / o2 + 1 / o3 - 1, 6) AS overround, round((1 / o1) / (1 / o1 + coalesce(1 / o2, 0) + 1 / o3), 6) AS fair1,
  round((o1 + coalesce(o2, 0) + o3) / CASE WHEN o2 IS NULL THEN 2 ELSE 3 END, 6) AS consensus, round(greatest((p * (o1 - 1) - (1 - p)) / (o1 - 1), 0), 6) AS kelly,
  round(least(0.25 * greatest((greatest(p - 0.02, 0.01) * (o1 - 1) - (1 - greatest(p - 0.02, 0.01))) / (o1 - 1), 0) * 1000, 30), 6) AS stake FROM {LINES}""")
def odds_and_stakes(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1.5 + F.col("l_quantity") / 10).alias("o1"), F.when(F.col("l_linenumber") != 3, 3 + F.col("l_discount")).alias("o2"), (2.0 + F.col("l_tax")).alias("o3"), (F.col("l_discount") * 5).alias("p"))
    o = [F.col("o1"), F.col("o2"), F.col("o3")]
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(fn.overround(*o)).alias("overround"), r6(fn.fair(0, *o)).alias("fair1"), r6(fn.mean_of(*o)).alias("consensus"),
        r6(fn.kelly(F.col("p"), o[0])).alias("kelly"), r6(fn.shrunk_stake(F.col("p"), o[0], F.lit(0.02), 1000.0)).alias("stake"),
    )


@query("""SELECT o_orderkey, round(CASE WHEN t > 0.1 THEN f * 0.1 / t ELSE f END, 9) AS capped FROM (SELECT o_orderkey, o_totalprice / 5000000 AS f, sum(o_totalprice / 5000000) OVER (PARTITION BY o_custkey) AS t FROM orders)""")
def group_caps(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 5000000).alias("f"))
    return o.select("o_orderkey", F.round(fn.group_cap(F.col("f"), 0.1, "o_custkey"), 9).alias("capped"))


@query(f"""SELECT id, CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS points, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS label,
  home_score + away_score > 50 AS over50, home_score > 0 AND away_score > 0 AS both, lpad(CAST((year(day) - CAST(month(day) < 8 AS INTEGER)) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(day) - CAST(month(day) < 8 AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0') AS code,
  CAST(isodow(day) - 1 AS INTEGER) AS weekday, (month(day) = 12 AND day(day) >= 20) OR (month(day) = 1 AND day(day) <= 3) AS holidays FROM {MEETINGS}""".replace("day(day)", "dayofmonth(day)"))
def labels_and_dates(spark, sf):
    m, h, a, d = meetings(spark, sf), F.col("home_score"), F.col("away_score"), F.col("day")
    return m.select("id", fn.points(h, a).alias("points"), fn.three_way(h, a).alias("label"), (h + a > 50).alias("over50"), fn.both_positive(h, a).alias("both"), fn.season_code(d).alias("code"), F.weekday(d).alias("weekday"), fn.holidays(d).alias("holidays"))


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS brand, lower(trim(p_name)) AS key, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'warm or cold' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' ELSE 'unknown' END AS class,
  CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'STANDARD' THEN 'BASIC' ELSE p_type END AS kind FROM part""")
def text_functions(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", fn.number(F.regexp_extract("p_brand", r"([0-9]+)", 1)).alias("brand"), F.lower(F.trim(name)).alias("key"),
        fn.first_match(name, [("^(red|blue)", "warm or cold"), ("ring$", "ring")], "unknown").alias("class"), fn.canonical_name(F.col("p_type"), {"ECONOMY": "BASIC", "STANDARD": "BASIC"}).alias("kind"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS bucket FROM events")
def json_fields(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.floor(k / 10).alias("bucket"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(coalesce(len(regexp_extract_all(html, '(?i)<a\s[^>]*href')), 0) AS INTEGER) AS links FROM pages""")
def html_fields(spark, sf):
    """Title and link count of raw pages, by regular expressions only."""
    links = F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href"), F.lit(0)))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.coalesce(links, F.lit(0)).alias("links"))


@query("""WITH s AS (SELECT season, dense_rank() OVER (ORDER BY season) AS r FROM (SELECT DISTINCT year(o_orderdate) AS season FROM orders)),
  f AS (SELECT a.r AS fold, a.season AS test FROM s a WHERE a.r > 3), t AS (SELECT f.fold, f.test, o_orderkey, o_totalprice, s.season, s.r, row_number() OVER (PARTITION BY fold, s.r < fold ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY fold, s.r < fold) AS n
  FROM orders JOIN s ON year(o_orderdate) = s.season JOIN f ON s.r BETWEEN f.fold - 3 AND f.fold)
  SELECT fold, CASE WHEN season = test THEN 'test' WHEN i > n * 0.8 THEN 'calibration' ELSE 'train' END AS part, count(*) AS n, round(median(o_totalprice), 6) AS median FROM t GROUP BY ALL""")
def walk_forward_folds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.year("o_orderdate").alias("season"))
    f = stateful.walk_forward(o, "season", ["o_orderdate", "o_orderkey"], 3)
    f = materialised(f.select("fold", "part", "o_totalprice"))
    medians = exact_quantiles(f, ["o_totalprice"], ["fold", "part"]).select("fold", "part", r6("o_totalprice").alias("median"))
    return f.groupBy("fold", "part").agg(F.count("*").alias("n")).join(medians, ["fold", "part"])


@query("SELECT event_id, value, coalesce(value, m) AS filled FROM (SELECT event_id, event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events) LEFT JOIN (SELECT event_type, median(value) AS m FROM (SELECT event_type, ts, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events) WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) USING (event_type)")
def median_imputation(spark, sf):
    """Medians of the training rows fill every row's gaps."""
    from ..sources.tables import events

    e = events(spark, sf)
    m = exact_quantiles(e.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")), ["value"], ["event_type"]).withColumnRenamed("value", "m")
    return e.join(m, "event_type", "left").select("event_id", "value", F.coalesce("value", "m").alias("filled"))


@query()
def stratified_sample(spark, sf):
    """An exact share of each class, at least one row, without replacement."""
    return stateful.stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.1, 7)


STANDINGS = f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY day, id) AS i FROM {MEETINGS}),
  l AS (SELECT season, i, home AS team, 0 AS away_side, home_score AS gf, away_score AS ga FROM m UNION ALL SELECT season, i, away, 1, away_score, home_score FROM m),
  seen AS (SELECT season, team, min(2 * i + away_side) AS first FROM l GROUP BY ALL),
  state AS (SELECT m.season, m.id, m.i, seen.team, seen.first, coalesce(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END), 0) AS points, coalesce(sum(gf - ga), 0) AS gd, coalesce(sum(gf), 0) AS gf, count(gf) AS played
    FROM m JOIN seen ON m.season = seen.season AND seen.first <= 2 * m.i + 1 LEFT JOIN l ON l.season = m.season AND l.team = seen.team AND l.i < m.i GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY season, id) AS n_teams, nth_value(points, 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fourth FROM state WINDOW w AS (PARTITION BY season, id ORDER BY points DESC, gd DESC, gf DESC, first)),
  low AS (SELECT season, id, max(points) AS fourth_last FROM ranked WHERE position = n_teams - 3 GROUP BY ALL)
  SELECT m.id, h.n_teams, {", ".join(f"CAST({s}.{c} AS DOUBLE) AS {n}_{c}" for s, n in (("h", "home"), ("a", "away")) for c in ("position", "points", "gd", "played"))},
  {", ".join(f"CAST(CASE WHEN h.n_teams < 4 THEN 0 ELSE {s}.points - {s}.fourth END AS DOUBLE) AS {n}_to_fourth, CAST(CASE WHEN h.n_teams < 4 THEN 0 ELSE {s}.points - fourth_last END AS DOUBLE) AS {n}_to_fourth_last" for s, n in (("h", "home"), ("a", "away")))}
  FROM m JOIN ranked h ON h.id = m.id AND h.season = m.season AND h.team = m.home JOIN ranked a ON a.id = m.id AND a.season = m.season AND a.team = m.away LEFT JOIN low ON low.id = m.id AND low.season = m.season"""


@query(STANDINGS)
def running_standings(spark, sf):
    """Standing of both teams before each match among the teams seen so far in its season."""
    return stateful.standings(meetings(spark, sf), "season", ["day", "id"])


@query()
def ordered_team_caps(spark, sf):
    """Caps per team, applied in order inside each batch."""
    m = meetings(spark, sf).select("id", "day", "home", "away", (F.col("home_score") / 1000).alias("stake"))
    return stateful.team_caps(m, ["day"], ["id"], "home", "away", "stake", 0.06)


BOOK = f"""(SELECT id, day, home, away, home % 4 AS league, CASE WHEN id % 5 <> 0 THEN id % 3 END AS round, 0.35 + home_score / 100 AS p, 1.6 + away_score / 20 AS odds FROM {MEETINGS})"""
#: Teams of a day one after the other, on lists of that day's bets.
PORTFOLIO = f"""WITH RECURSIVE k AS (SELECT *, greatest((p * (odds - 1) - (1 - p)) / (odds - 1), 0) AS kelly FROM {BOOK}),
  m AS (SELECT *, least(0.25 * kelly, 0.03) AS f0, CASE WHEN 0.25 * kelly > 0.03 THEN 'match' END AS b0 FROM k),
  r AS (SELECT *, CASE WHEN round IS NOT NULL AND t > 0.0507 THEN f0 * 0.0507 / t ELSE f0 END AS f1, CASE WHEN round IS NOT NULL AND t > 0.0507 THEN 'round' ELSE b0 END AS b1 FROM (SELECT *, sum(f0) OVER (PARTITION BY day, round) AS t FROM m)),
  l AS (SELECT *, CASE WHEN u > 0.0613 THEN f1 * 0.0613 / u ELSE f1 END AS f2, CASE WHEN u > 0.0613 THEN 'league' ELSE b1 END AS b2 FROM (SELECT *, sum(f1) OVER (PARTITION BY day, league) AS u FROM r)),
  n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY id) AS i FROM l),
  firsts AS (SELECT day, team, min(x) AS x FROM (SELECT day, home AS team, 2 * i AS x FROM n UNION ALL SELECT day, away, 2 * i + 1 FROM n) GROUP BY ALL),
  days AS (SELECT day, list(id ORDER BY i) AS ids, list(home ORDER BY i) AS hs, list(away ORDER BY i) AS aws, list(f2 ORDER BY i) AS fs, list(coalesce(b2, '') ORDER BY i) AS bs FROM n GROUP BY day),
  teams AS (SELECT day, list(team ORDER BY x) AS ts FROM firsts GROUP BY day),
  w AS (SELECT day, ids, hs, aws, ts, 1 AS k, fs, bs FROM days JOIN teams USING (day) UNION ALL
    SELECT day, ids, hs, aws, ts, k + 1, list_transform(fs, lambda f, j: CASE WHEN total > 0.0353 AND (hs[j] = ts[k] OR aws[j] = ts[k]) THEN f * 0.0353 / total ELSE f END),
      list_transform(bs, lambda b, j: CASE WHEN total > 0.0353 AND (hs[j] = ts[k] OR aws[j] = ts[k]) THEN 'team' ELSE b END)
    FROM (SELECT *, list_sum(list_transform(fs, lambda f, j: CASE WHEN hs[j] = ts[k] OR aws[j] = ts[k] THEN f ELSE 0.0 END)) AS total FROM w WHERE k <= len(ts)))
  SELECT id, round(edge, 9) AS edge, round(stake, 9) AS stake, nullif(bound, '') AS bound FROM (SELECT unnest(ids) AS id, unnest(fs) AS stake, unnest(bs) AS bound FROM w WHERE k = len(ts) + 1) JOIN (SELECT id, p - 1 / odds AS edge FROM k) USING (id)"""


@query(PORTFOLIO)
def portfolio_stakes(spark, sf):
    """Stakes of each day's bets under the limits of matches, rounds, leagues and teams."""
    m = meetings(spark, sf)
    round_ = F.when(F.col("id") % 5 != 0, F.col("id") % 3)
    book = m.select("id", "day", "home", "away", (F.col("home") % 4).alias("league"), round_.alias("round"), (0.35 + F.col("home_score") / 100).alias("p"), (1.6 + F.col("away_score") / 20).alias("odds"))
    out = portfolio.portfolio_stakes(book, ["day"], ["id"], "p", "odds", "home", "away", "round", "league", per_round=0.0507, per_league=0.0613, per_team=0.0353)
    return out.select("id", F.round("edge", 9).alias("edge"), F.round("stake", 9).alias("stake"), "bound")
