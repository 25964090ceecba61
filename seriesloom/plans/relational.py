"""Queries of joins, reshapes, set operations and table updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as rel
from ..operators import windows as win
from ..sources.tables import MEETINGS, events, meetings, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LOG = f"""(SELECT id, day, season, 'home' AS side, home AS team, away AS other, home_score AS gf, away_score AS ga FROM {MEETINGS}
  UNION ALL SELECT id, day, season, 'away', away, home, away_score, home_score FROM {MEETINGS})"""
LOGGED = f"""(SELECT *, CASE WHEN count(gf) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN avg(gf) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS form FROM {LOG})""".replace(
    "(w ROWS", "(PARTITION BY team, season ORDER BY day, id, side ROWS"
)


def team_log(spark, sf):
    m = meetings(spark, sf)
    return rel.two_sided_log(m, ["id", "day", "season"], {"team": "home", "other": "away", "gf": "home_score", "ga": "away_score"}, {"team": "away", "other": "home", "gf": "away_score", "ga": "home_score"})


@query(f"SELECT id, side, team, other, gf, ga FROM {LOG}")
def two_sided_log(spark, sf):
    return team_log(spark, sf).select("id", "side", "team", "other", "gf", "ga")


@query(f"""SELECT m.id, round(max(CASE WHEN side = 'home' THEN form END), 6) AS home_form, round(max(CASE WHEN side = 'away' THEN form END), 6) AS away_form
  FROM {MEETINGS} m LEFT JOIN {LOGGED} l ON m.id = l.id GROUP BY m.id""")
def side_join(spark, sf):
    form = win.rolling_full(F.col("gf"), win.history(["team", "season"], ["day", "id", "side"]), 3)
    log = team_log(spark, sf).withColumn("form", F.round(form, 6))
    return rel.sides(log, "id", ["form"])  # the log holds every id


@query("""SELECT p.event_id, v.event_id AS seen_id, v.value AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_strict(spark, sf):
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return rel.asof_join(left, views, ["user_id"], "ts", "ts", ["seen_id", "seen_value"]).select("event_id", "seen_id", "seen_value")


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'click') AS has FROM events GROUP BY user_id),
  r AS (SELECT e.* FROM events e JOIN u USING (user_id) WHERE e.event_type <> 'purchase' AND (e.event_type = 'click' OR NOT u.has))
  SELECT p.event_id, r.event_id AS seen_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts > r.ts""")
def asof_preferred_level(spark, sf):
    """As-of join on the preferred kind where the entity has any row of it, else on all."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    has = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("has"))
    right = e.where("event_type <> 'purchase'").join(has, "user_id").where("event_type = 'click' or not has")
    right = right.select("user_id", "ts", F.col("event_id").alias("seen_id"))
    return rel.asof_join(e.where("event_type = 'purchase'"), right, ["user_id"], "ts", "ts", ["seen_id"]).select("event_id", "seen_id")


@query("""SELECT p.event_id, (SELECT s.event_id FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND abs(date_diff('day', CAST(s.ts AS DATE), CAST(p.ts AS DATE))) <= 1
  ORDER BY abs(date_diff('day', CAST(s.ts AS DATE), CAST(p.ts AS DATE))), s.event_id LIMIT 1) AS near_id FROM events p WHERE p.event_type = 'purchase'""")
def nearest_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("near_ts"), F.col("event_id").alias("near_id"))
    return rel.nearest_join(e.where("event_type = 'purchase'"), right, ["user_id"], "ts", "near_ts", 1, ["event_id"], ["near_id"]).select("event_id", "near_id")


@query("""SELECT p.event_id, coalesce((SELECT s.event_id FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND abs(date_diff('day', CAST(s.ts AS DATE), CAST(p.ts AS DATE))) <= 1
  ORDER BY abs(date_diff('day', CAST(s.ts AS DATE), CAST(p.ts AS DATE))), s.ts, s.event_id LIMIT 1),
  (SELECT CASE WHEN count(*) = 1 THEN min(s.event_id) END FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id), p.event_id) AS repaired FROM events p WHERE p.event_type = 'purchase'""")
def key_repair(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return rel.repaired_keys(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), ["user_id"], "ts", "event_id").select("event_id", "repaired")


@query("""SELECT c_custkey, s_suppkey, s_acctbal FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) ON c_nationkey = s_nationkey WHERE n = 1""")
def best_match(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    return rel.best_match(c, s, ["c_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")]).select("c_custkey", "s_suppkey", "s_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def full_join(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").select("k", "customers", "suppliers")


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey - b.n_regionkey AS delta FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey")
def theta_pairs(spark, sf):
    """Differences over all pairs of a small dimension."""
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), F.broadcast(n.alias("b"))
    return a.join(b, F.col("a.n_nationkey") > F.col("b.n_nationkey")).select(F.col("a.n_nationkey").alias("i"), F.col("b.n_nationkey").alias("j"), (F.col("a.n_regionkey") - F.col("b.n_regionkey")).alias("delta"))


@query("""SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)
  UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)""")
def key_sets(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("part"), "k").unionByName(a.subtract(b).select(F.lit("left").alias("part"), "k"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_acctbal IS NOT NULL THEN c_acctbal END AS o_totalprice FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY') ON o_custkey = c_custkey")
def overwrite_join(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"))
    return rel.overwrite_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), c, ["o_custkey"])


def _batches(spark, sf):
    """Orders up to 1999, and those from the middle of 1999 on at new prices and without two columns."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    new = o.where("o_orderdate >= timestamp '1999-07-01'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return o.where("o_orderdate < timestamp '2000-01-01'").drop("o_orderdate"), new


OLD = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')"
NEW = "(SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-07-01')"


@query(f"SELECT * FROM {OLD} a WHERE NOT EXISTS (SELECT 1 FROM {NEW} n WHERE n.o_orderkey = a.o_orderkey) UNION ALL SELECT o_orderkey, NULL, NULL, o_totalprice FROM {NEW}")
def upsert_replace(spark, sf):
    return rel.upsert(*_batches(spark, sf), ["o_orderkey"], "replace")


@query(f"SELECT coalesce(a.o_orderkey, n.o_orderkey) AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE a.o_totalprice END AS o_totalprice FROM {OLD} a FULL JOIN {NEW} n ON a.o_orderkey = n.o_orderkey")
def upsert_merge(spark, sf):
    return rel.upsert(*_batches(spark, sf), ["o_orderkey"], "merge")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate >= TIMESTAMP '1998-01-01' DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def append_keep_last(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")
    out = rel.keep_last([li.where(~late), li.where(late)], ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT conv_id, turn // 2 AS pair, max(CASE WHEN role = 'user' THEN length(text) END) AS user_chars, max(CASE WHEN role = 'assistant' THEN length(text) END) AS assistant_chars FROM conversations GROUP BY ALL")
def pivot_pair(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("pair"), "role", F.char_length("text").cast("long").alias("n"))
    return c.groupBy("conv_id", "pair").pivot("role", ["user", "assistant"]).agg(F.max("n")).withColumnsRenamed({"user": "user_chars", "assistant": "assistant_chars"})
