"""Queries of joins by names and by keys of two levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from ..sources.tables import MEETINGS, meetings, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


APPEARANCES = """(SELECT o_orderkey AS game, o_custkey % 5 AS team, CASE o_orderkey % 3 WHEN 0 THEN upper(c_name) || ' ' WHEN 1 THEN '  ' || c_name ELSE lower(c_name) END AS player, year(o_orderdate) AS season FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, o_custkey % 5, c_name, year(o_orderdate) - 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 = 0)"""
RATINGS = "(SELECT c_name || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END AS player_name, year(o_orderdate) AS version, floor(o_totalprice / 20000) AS overall, o_orderkey AS rating_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_custkey % 4 <> 0)"


@query(f"""SELECT game, team, player, season, version, overall, rating_id FROM (
  SELECT *, row_number() OVER (PARTITION BY game, team, lower(trim(player)) ORDER BY coalesce(season = version, false) DESC, overall DESC, player, season, rating_id) AS n
  FROM {APPEARANCES} JOIN {RATINGS} ON lower(trim(player)) = lower(trim(player_name))) WHERE n = 1""")
def name_match(spark, sf):
    """Players' ratings by name: of their season, else the best of any. Some appearances are told twice, with another season."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    team, season = F.col("o_custkey") % 5, F.year("o_orderdate")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.upper("c_name"), F.lit(" "))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("  "), F.col("c_name"))).otherwise(F.lower("c_name"))
    left = o.select(F.col("o_orderkey").alias("game"), team.alias("team"), name.alias("player"), season.alias("season"))
    left = left.unionByName(o.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("game"), team.alias("team"), F.col("c_name").alias("player"), (season - 1).alias("season")))
    left = left.withColumn("who", matching.folded_key(F.col("player")))
    rated = o.where("o_orderstatus = 'F' and o_custkey % 4 <> 0").select(
        F.concat("c_name", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("")).alias("player_name"), season.alias("version"), F.floor(F.col("o_totalprice") / 20000).cast("double").alias("overall"), F.col("o_orderkey").alias("rating_id")
    )
    out = matching.preferred_match(left, rated, ("player", "player_name"), ("season", "version"), "overall", ["game", "team", "who"], ["rating_id"])
    return out.select("game", "team", "player", "season", "version", "overall", "rating_id")


SHOTS = "(SELECT c_nationkey AS team, CAST(o_orderdate AS DATE) AS day, o_orderkey AS game, count(*) AS shots, sum(l_quantity) AS volume FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0 GROUP BY ALL)"
CORNERS = "(SELECT c_nationkey AS team, CAST(o_orderdate AS DATE) AS day, o_orderkey AS game, o_orderstatus AS corner FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0)"
CONCEDED = "(SELECT c_nationkey AS team, CAST(o_orderdate AS DATE) AS day, o_orderkey AS game, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 3 = 0)"


def _level(name: str, side: str, columns: str) -> str:
    got = ", ".join(f"CASE WHEN f.game IS NOT NULL THEN f.{c} ELSE c.{c} END AS {name}_{c}" for c in columns.split())
    last = ", ".join(f"arg_max({c}, game) AS {c}" for c in columns.split())
    return f"SELECT m.id, {got} FROM m LEFT JOIN {side} f ON f.team = m.home AND f.day = m.day AND f.game = m.id LEFT JOIN (SELECT team, day, {last} FROM {side} GROUP BY team, day) c ON c.team = m.home AND c.day = m.day"


@query(f"""WITH m AS (SELECT id, CASE WHEN id % 50 <> 0 THEN home END AS home, day FROM {MEETINGS})
  SELECT * FROM ({_level("shot", SHOTS, "shots volume")}) JOIN ({_level("corner", CORNERS, "corner")}) USING (id) JOIN ({_level("against", CONCEDED, "price")}) USING (id)""")
def two_level_lookups(spark, sf):
    """Three tables' columns beside each match: by team, day and game, else by team and day. Some matches lack their team."""
    m = meetings(spark, sf).select("id", F.when(F.col("id") % 50 != 0, F.col("home")).alias("team"), "day", F.col("id").alias("game"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_nationkey").alias("team"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("game"), "o_orderstatus", "o_totalprice", "o_custkey")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.count("*").alias("shots"), F.sum("l_quantity").alias("volume"))
    sides = {
        "shot": (o.where("game % 3 <> 0").join(lines, "game"), ["shots", "volume"]),
        "corner": (o.where("game % 2 = 0").withColumnRenamed("o_orderstatus", "corner"), ["corner"]),
        "against": (o.where("o_custkey % 3 = 0").withColumnRenamed("o_totalprice", "price"), ["price"]),
    }
    rows = table(spark, sf, "orders").count() * 5 // 2  # a match and 2/3, 1/2 and 1/3 of a row of the sides for each; read from the files' footers
    out = matching.two_level_lookup(m, sides, ["team", "day"], ["game"], rows=rows)
    return out.select("id", "shot_shots", "shot_volume", "corner_corner", "against_price")


SET_PIECE_ROWS = """(SELECT l_orderkey AS game, sum(CAST(l_linenumber = 1 AND l_discount > 0.05 AS INTEGER)) AS goals_from_corners, sum(CAST(l_linenumber = 1 AS INTEGER)) AS shots_from_corners, round(sum(CASE WHEN l_linenumber = 1 THEN l_tax ELSE 0 END), 6) AS xg_from_corners,
  sum(CAST(l_returnflag = 'A' AS INTEGER)) AS corners_won, sum(CAST(l_returnflag = 'R' AS INTEGER)) AS opponent_corners, sum(CAST(l_returnflag = 'R' AND l_tax > 0.04 AS INTEGER)) AS goals_conceded_from_corners,
  sum(CAST(l_linenumber = 2 AND l_discount > 0.05 AS INTEGER)) AS goals_from_fk, sum(CAST(l_linenumber = 2 AS INTEGER)) AS shots_from_fk, round(sum(CASE WHEN l_linenumber = 2 THEN l_tax ELSE 0 END), 6) AS xg_from_fk,
  sum(CAST(l_linenumber <= 2 AND l_discount > 0.05 AS INTEGER)) AS goals_from_setpieces, sum(CAST(l_discount > 0.05 AS INTEGER)) AS total_goals, sum(CAST(l_linenumber > 2 AND l_discount > 0.05 AS INTEGER)) AS goals_open_play,
  sum(CAST(l_linenumber > 2 AS INTEGER)) AS shots_open_play, round(sum(CASE WHEN l_linenumber > 2 THEN l_tax ELSE 0 END), 6) AS xg_open_play, sum(CAST(l_tax > 0.06 AS INTEGER)) AS goals_conceded_from_setpieces FROM lineitem GROUP BY l_orderkey)"""


@query(f"""SELECT game, {", ".join(f"round({a} / nullif({b}, 0), 6) AS {n}" for n, a, b in matching.SET_PIECES)}, CAST(goals_conceded_from_setpieces AS DOUBLE) AS sp_defensive_vulnerability FROM {SET_PIECE_ROWS}""")
def set_piece_ratios(spark, sf):
    """Ten ratios of shots, goals and corners by game, null where there was none to divide by."""
    n = lambda test: F.sum(F.expr(test).cast("int"))
    xg = lambda test: F.round(F.sum(F.when(F.expr(test), F.col("l_tax")).otherwise(0)), 6)
    goal = "l_discount > 0.05"
    stats = {
        "goals_from_corners": n(f"l_linenumber = 1 and {goal}"), "shots_from_corners": n("l_linenumber = 1"), "xg_from_corners": xg("l_linenumber = 1"),
        "corners_won": n("l_returnflag = 'A'"), "opponent_corners": n("l_returnflag = 'R'"), "goals_conceded_from_corners": n("l_returnflag = 'R' and l_tax > 0.04"),
        "goals_from_fk": n(f"l_linenumber = 2 and {goal}"), "shots_from_fk": n("l_linenumber = 2"), "xg_from_fk": xg("l_linenumber = 2"),
        "goals_from_setpieces": n(f"l_linenumber <= 2 and {goal}"), "total_goals": n(goal), "goals_open_play": n(f"l_linenumber > 2 and {goal}"),
        "shots_open_play": n("l_linenumber > 2"), "xg_open_play": xg("l_linenumber > 2"), "goals_conceded_from_setpieces": n("l_tax > 0.06"),
    }
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(*[c.alias(k) for k, c in stats.items()])
    out = matching.set_piece_ratios(rows)
    return out.select("game", *[F.round(c, 6).alias(c) for c, _, _ in matching.SET_PIECES], "sp_defensive_vulnerability")
