"""Queries of sources and sinks: driver tables are written in a form and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names
from ..session import scratch_path
from ..sources import files, sinks
from ..sources.tables import table
from ..sources.versions import file_system

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


TABLES = ("nation", "supplier", "orders")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def filtered_scan(spark, sf):
    """A named table, its equality filters pushed down; an empty filter is skipped."""
    return files.scan(spark, sf, "supplier", TABLES, {"s_nationkey": 7, "s_name": ""}).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 250000 AND o_orderstatus IN ('F', 'P') AND o_custkey <> 7")
def ranged_scan(spark, sf):
    """Ranges, a list and an inequality, all pushed down; a bound that isn't told is skipped."""
    where = {"o_totalprice": [(">=", 100000.0), ("<", 250000.0)], "o_orderstatus": ["F", "P"], "o_custkey": ("!=", 7), "o_orderdate": [(">", None)]}
    return files.scan(spark, sf, "orders", TABLES, where).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' Team ' || (o_custkey % 5) || '-' || CASE WHEN o_orderkey % 3 = 0 THEN 'Third' ELSE 'FC ' || (o_orderkey % 3) END END AS game, o_totalprice AS price, year(o_orderdate) AS year FROM orders""")
def csv_games(spark, sf):
    """Season files with quoted headers that hold commas and come twice; names by a dictionary, dates of two formats, and the games' keys."""
    root = scratch_path(spark, "csv-games")
    o = table(spark, sf, "orders")
    home = F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("Téam "), F.col("o_custkey") % 5))
    away = F.when(F.col("o_orderkey") % 3 == 0, "3rd").otherwise(F.concat(F.lit(" FC "), F.col("o_orderkey") % 3))
    day = F.when(F.year("o_orderdate") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select(F.col("o_orderkey").alias("Id"), day.alias("Date, local"), home.alias("HomeTeam"), away.alias("AwayTeam"), F.lit("x").alias("Odds"), F.col("o_totalprice").alias("Price"), F.lit("grp").alias("grp"), F.year("o_orderdate").alias("period"))
    lines = rows.select("grp", "period", F.concat_ws(",", "Id", "`Date, local`", F.coalesce("HomeTeam", F.lit("")), F.concat(F.lit('"'), F.col("AwayTeam"), F.lit('"')), "Odds", "Price").alias("value"))
    head = rows.select("grp", "period").distinct().withColumn("value", F.lit('Id,"Date, local",HomeTeam,AwayTeam,Odds,Odds'))
    files_of = head.withColumn("n", F.lit(0)).unionByName(lines.withColumn("n", F.lit(1))).repartition("grp", "period").sortWithinPartitions("grp", "period", "n")
    files_of.select("grp", "period", "value").write.partitionBy("grp", "period").option("encoding", "UTF-8").format("text").save(root)
    _as_csv(spark, root)
    read = files.read_csv_files(spark, root, [(("Date, local",), {"Id": "id", "Date, local": "day", "HomeTeam": "home", "AwayTeam": "away"})], ["id", "day"], None, r"grp=([^/]+)/period=([^/]+)/[^/]+\.csv$", encoding="UTF-8")
    named = read.select("id", "day", "home", "away", F.col("`Odds.1`").alias("price"), "period")
    teams = o.select(F.concat(F.lit("Team "), F.col("o_custkey") % 5).alias("name")).distinct()
    words = names.dictionary(spark.createDataFrame([("3rd", "Third")], "alias string, name string"), teams)
    out = files.with_game_key(named, F.to_date(files.any_time(F.col("day"), "dd/MM/yyyy", "yyyy-MM-dd")), "home", "away", words)
    return out.select(F.col("id").cast("long").alias("id"), "game", F.col("price").cast("double").alias("price"), F.col("period").cast("long").alias("year"))


def _as_csv(spark, root: str) -> None:
    """Names the text files that Spark wrote below root as CSV files."""
    for path in files.list_files(spark, root, "*.txt"):
        old, fs = file_system(spark, path)
        new, _ = file_system(spark, path.removesuffix(".txt") + ".csv")
        fs.rename(old, new)


ORDER_NAMES = [(("Key", "Team"), {"Key": "id", "Team": "team", "Price": "price", "Day": "day"}), (("OrderKey",), {"OrderKey": "id", "HomeTeam": "team", "Odds": "price", "Date": "day"})]


@query("""SELECT o_orderkey AS id, o_custkey AS team, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year, o_orderstatus AS grp
  FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def csv_seasons(spark, sf):
    """CSV files in two dialects, one of which has prices that are no numbers, below folders that
    tell group and year; a group that isn't listed is not read."""
    root = scratch_path(spark, "csv-seasons")
    o = table(spark, sf, "orders").withColumns({"grp": F.col("o_orderstatus"), "period": F.year("o_orderdate")})
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    old = o.where(early).select(F.col("o_orderkey").alias("Key"), F.col("o_custkey").alias("Team"), F.lit("n/a").alias("Price"), F.date_format("o_orderdate", "dd/MM/yy").alias("Day"), "grp", "period")
    new = o.where(~early).select(F.col("o_orderkey").alias("OrderKey"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.lit("x").alias("Junk"), F.col("o_custkey").alias("HomeTeam"), F.col("o_totalprice").alias("Odds"), "grp", "period")
    for part in (old, new):
        part.write.mode("append").partitionBy("grp", "period").option("header", True).csv(root)
    read = files.read_csv_files(spark, root, ORDER_NAMES, ["id", "team", "day"], {"grp": ["F", "O"]}, r"grp=([^/]+)/period=([^/]+)/[^/]+\.csv$")
    read = files.numbers(read, ["price"]).where("team is not null")
    return read.select(F.col("id").cast("long").alias("id"), F.col("team").cast("long").alias("team"), "price", F.to_date(files.any_time(F.col("day"), "dd/MM/yyyy", "dd/MM/yy")).alias("day"), F.col("period").cast("long").alias("year"), "grp")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY l_shipdate = max(l_shipdate) OVER (PARTITION BY l_suppkey)")
def latest_updates(spark, sf):
    return files.latest_updates(table(spark, sf, "lineitem"), ["l_suppkey"], "l_shipdate").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_brand = 'Brand#7' AND p_size > 25")
def csv_scan(spark, sf):
    """A large CSV: two columns and a predicate, in splits."""
    path = scratch_path(spark, "csv-scan")
    table(spark, sf, "part").write.option("header", True).csv(path)
    read = spark.read.csv(path, header=True, schema=table(spark, sf, "part").schema)
    return read.where("p_brand = 'Brand#7' and p_size > 25").select("p_partkey", "p_retailprice")


@query("SELECT event_id, event_type, value FROM events")
def json_envelopes(spark, sf):
    """Lists of items, bare or under one of two keys, and a broken file."""
    root = scratch_path(spark, "json-envelopes")
    e = table(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    day = e.groupBy("day").agg(F.collect_list(F.struct("event_id", "event_type", "value")).alias("x"))
    kind = F.pmod(F.col("day"), F.lit(3))
    told = F.when(kind == 0, F.to_json("x")).when(kind == 1, F.to_json(F.struct(F.col("x").alias("predictions")))).otherwise(F.to_json(F.struct(F.col("x").alias("results"))))
    day.select(told.alias("value"), "day").write.partitionBy("day").text(root)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{root}/day=0")
    return files.read_envelope(spark, f"{root}/day=*", "struct<event_id: long, event_type: string, value: double>", ["predictions", "results"])


@query("SELECT event_id, event_type AS shots_home, CAST(event_id AS VARCHAR) AS shots_away, CAST(user_id AS VARCHAR) AS fouls_home FROM events")
def statistics_flatten(spark, sf):
    """Nested statistics of the whole match as columns; other periods are left out, and the last item of a key counts."""
    text = lambda c: F.col(c).cast("string")
    item = lambda key, home, away: F.struct(F.lit(key).alias("key"), home.alias("home"), away.alias("away"))
    group = lambda *items: F.struct(F.array(*items).alias("statisticsItems"))
    groups = F.array(group(item("shots", text("user_id"), text("user_id")), item("fouls", text("user_id"), text("event_id"))), group(item("shots", text("event_type"), text("event_id"))))
    early = F.struct(F.lit("1ST").alias("period"), F.array(group(item("shots", F.lit("0"), F.lit("0")))).alias("groups"))
    raw = F.to_json(F.struct(F.array(early, F.struct(F.lit("ALL").alias("period"), groups.alias("groups"))).alias("statistics")))
    stats = files.flatten_statistics(F.col("raw"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", *[stats[c].alias(c) for c in ("shots_home", "shots_away", "fouls_home")])


@query("SELECT n_name AS home, 'R' || n_regionkey AS away, DATE '2024-03-05' AS day, CAST(n_nationkey AS VARCHAR) AS shots_home FROM nation")
def cached_statistics(spark, sf):
    """A JSON file for each record, in two forms; broken files are told apart."""
    root = scratch_path(spark, "cached-statistics")
    n = table(spark, sf, "nation")
    away, stats = F.concat(F.lit("R"), F.col("n_regionkey")), F.create_map(F.lit("shots_home"), F.col("n_nationkey").cast("string"))
    typed = F.to_json(F.struct(F.col("n_name").alias("home_team"), away.alias("away_team"), F.lit("2024-03-05").alias("date"), stats.alias("stats")))
    raw = F.to_json(F.struct(F.col("n_name").alias("homeTeam"), away.alias("awayTeam"), F.lit(1709632800).alias("startTimestamp"), stats.alias("stats")))
    n.select(F.when(F.col("n_regionkey") > 1, typed).otherwise(raw).alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(root)
    spark.createDataFrame([("no json",)], "value string").write.text(f"{root}/n_nationkey=broken")
    return files.read_cached_statistics(spark, root).where("not broken").select("home", "away", "day", F.col("stats")["shots_home"].alias("shots_home"))


@query("""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<p>[^<]*</p>')) AS lines FROM pages
  WHERE len(regexp_extract_all(html, '<p>[^<]*</p>')) > 0""")
def page_rows(spark, sf):
    """Paragraphs of a page under the heading that stands before them."""
    rows = files.carried_rows(table(spark, sf, "pages"), ["page_id"], "html", r"<h1>[^<]*</h1>|<p>[^<]*</p>", r"<h1>([^<]*)</h1>")
    return rows.groupBy("page_id", "heading").agg(F.count("*").alias("lines"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate AS kickoff, market, price FROM (SELECT *, unnest(['H', 'D', 'A']) AS market, unnest([l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_discount END, l_tax]) AS price FROM lineitem WHERE l_linestatus = 'O')
  WHERE price IS NOT NULL""")
def page_markets(spark, sf):
    """Three markets of a page element; elements that lack a field and prices that are none are left out."""
    status = F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm")).otherwise("")
    element = F.concat(F.lit("<div><i>"), status, F.lit("</i><b>"), F.col("l_quantity"), F.lit("</b><s>"), F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_discount").cast("string")), F.lit("</s><u>"), F.col("l_tax"), F.lit("</u></div>"))
    markets = [("H", "<b>([^<]*)</b>"), ("D", "<s>([^<]*)</s>"), ("A", "<u>([^<]*)</u>")]
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(files.markets_of(element, {"at": "<i>([^<]*)</i>"}, markets)).alias("m"))
    return li.select("l_orderkey", "l_linenumber", F.try_to_timestamp("m.at", F.lit("yyyy-MM-dd HH:mm")).alias("kickoff"), "m.market", "m.price")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer")
def table_overwrite(spark, sf):
    """Written twice: the second write replaces the first as a whole."""
    path = scratch_path(spark, "overwrite")
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    sinks.overwrite(c.withColumn("c_acctbal", F.lit(0.0)), path, ["c_nationkey"])
    sinks.overwrite(c, path, ["c_nationkey"])
    return sinks.read_table(spark, path)


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate >= TIMESTAMP '1999-01-01', o_orderdate, o_orderkey)) AS o_orderkey,
  CASE WHEN max(o_orderdate) >= TIMESTAMP '1999-01-01' THEN arg_max(o_orderpriority, (o_orderdate, o_orderkey)) END AS o_orderpriority FROM orders GROUP BY o_custkey""")
def append_on_disk(spark, sf):
    """Two batches, the second with one more column; of each customer the last order stays."""
    path = scratch_path(spark, "append")
    o = table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")
    sinks.append_keep_last(o.where(~late).select("o_custkey", "o_orderkey", "o_orderdate"), path, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    sinks.append_keep_last(o.where(late).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), path, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return sinks.read_table(spark, path).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer""")
def typed_store(spark, sf):
    """Only the store's columns, renamed; the second batch changes what it has and keeps the rest."""
    path = scratch_path(spark, "store")
    c, columns = table(spark, sf, "customer"), ["c_custkey", "c_name", "balance", "absent"]
    sinks.store(c, path, columns, ["c_custkey"], {"c_acctbal": "balance"})
    some = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    sinks.store(some, path, columns, ["c_custkey"], {"c_acctbal": "balance"})
    return sinks.read_table(spark, path)


@query("""SELECT n_name AS source, 'R' || n_regionkey AS grp, CAST(n_nationkey % 4 AS VARCHAR) AS period FROM nation WHERE NOT (n_nationkey % 4 <> 0 AND n_name NOT LIKE '%1' AND n_nationkey % 4 <> 3)""")
def load_ledger(spark, sf):
    """What is still to be loaded after failures, a success at a second try and two deletions."""
    ledger = sinks.Ledger(spark, scratch_path(spark, "ledger"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("grp"), (F.col("n_nationkey") % 4).cast("string").alias("period"))
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp").alias("at")
    ledger.record(n.select("*", at(1), F.lit(9).cast("long").alias("n"), F.when(F.col("period").isin("0", "1"), "failed").otherwise("success").alias("status")))
    ledger.record(n.where("period = '1'").select("*", at(2), F.lit(9).cast("long").alias("n"), F.lit("success").alias("status")))
    ledger.forget(F.col("source").like("%1"))
    ledger.forget(F.col("period") == "3")
    return ledger.unread(n)


@query("SELECT s_suppkey, s_name, s_acctbal, n.rows, n.columns, n.n_nations FROM supplier, (SELECT count(*) AS rows, 4 AS columns, count(DISTINCT s_nationkey) AS n_nations FROM supplier) n")
def json_sink(spark, sf):
    """Rows as JSON with a line about the table beside them."""
    path = scratch_path(spark, "json")
    sinks.write_json(table(spark, sf, "supplier"), path, {"nations": ["s_nationkey"]})
    about = spark.read.json(f"{path}.about").select("rows", "columns", F.size("s_nationkey").cast("long").alias("n_nations"))
    rows = spark.read.json(path, schema="s_suppkey long, s_name string, s_acctbal double")
    return rows.crossJoin(F.broadcast(about))  # one row


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS before, count(*) AS after, round(sum(o_totalprice), 2) AS total FROM orders")
def table_copy(spark, sf):
    """Rows that the target has are not copied again; counts tell what was added."""
    path = scratch_path(spark, "copy")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.copy_missing(o.where("o_orderstatus = 'F'"), path, ["o_orderkey"])
    before, after = sinks.copy_missing(o.unionByName(o), path, ["o_orderkey"])
    return sinks.read_table(spark, path).agg(F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, 2 AS labels, true AS odds_in_range, 3 AS groups, true AS centred FROM orders")
def made_up_rows(spark, sf):
    """As many made-up rows as there are orders."""
    m = files.made_up(spark, table(spark, sf, "orders").count(), 2, 2, 7, ["a", "b", "c"])
    return m.agg(
        F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min((F.col("odds") >= 1.5) & (F.col("odds") < 5)).alias("odds_in_range"), F.count_distinct("grp").alias("groups"),
        ((F.abs(F.avg("x0")) < 0.15) & (F.abs(F.stddev("x1") - 1) < 0.15)).alias("centred"),
    )
