"""Queries of names, keys and verdicts on what the tables' own rows hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import names
from ..operators import projections as pro
from ..sources.tables import MEETINGS, meetings, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _plain(x: str) -> str:
    x = f"strip_accents({x})"
    for a, b in names.LETTERS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}{{2,}}')) AS w FROM documents),
  n AS (SELECT w, CASE WHEN length(w) % 2 = 0 THEN {_plain("w")} ELSE w END AS raw FROM w), k AS (SELECT {_plain("w")} AS plain, min(w) AS name FROM w WHERE length(w) <> 3 GROUP BY 1)
  SELECT n.w, coalesce(e.name, f.name, x.w, k.name, raw) AS name FROM n LEFT JOIN (SELECT w, 'short ' || w AS name FROM w WHERE length(w) = 3) e ON e.w = raw LEFT JOIN (SELECT w, 'short ' || w AS name FROM w WHERE length(w) = 3) f ON f.w = {_plain("raw")}
  LEFT JOIN (SELECT w FROM w WHERE length(w) <> 3) x ON x.w = raw LEFT JOIN k ON k.plain = {_plain("raw")}""")
def name_dictionary(spark, sf):
    """Every word of all documents, half of them without their accents, brought back to a known spelling or an alias."""
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))).alias("w")).distinct()
    short = F.char_length("w") == 3
    words = names.dictionary(w.where(short).select(F.col("w").alias("alias"), F.concat(F.lit("short "), F.col("w")).alias("name")), w.where(~short).select(F.col("w").alias("name")))
    raw = F.when(F.char_length("w") % 2 == 0, F.concat(F.lit("  "), names.unaccented(F.col("w")), F.lit(" "))).otherwise(F.col("w"))
    return names.resolve(w.withColumn("raw", raw), "raw", words, "name").select("w", "name")


@query("SELECT o_orderkey, o_orderpriority, n, 1 + n % 2 AS tier FROM orders JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) USING (o_orderpriority) WHERE n % 2 = 0")
def registry_filter(spark, sf):
    """Orders of the priorities that a registry, made of the table, puts in its first tier."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    registry = o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("tier", 1 + F.col("n") % 2)
    return names.registered(o, registry, "o_orderpriority", 1)


@query(f"""WITH k AS (SELECT id, strftime(day, '%Y-%m-%d') || ' Real-Club-' || home || '-' || CASE WHEN id % 7 = 0 THEN 'Unknown-' || away ELSE 'Real-Club-' || away END AS key FROM {MEETINGS})
  SELECT id, substr(key, 1, 10) AS day, CASE WHEN id % 7 = 0 THEN regexp_extract(key, '^\\S+ (Real-Club-\\d+)-Unknown', 1) ELSE regexp_extract(key, '^\\S+ (Real-Club-\\d+)-Real', 1) END AS home, regexp_extract(key, '-((Real-Club|Unknown)-\\d+)$', 1) AS away FROM k""")
def game_keys(spark, sf):
    """Keys of day and two names, both full of hyphens, of which one may be unknown, cut at the right one."""
    m = meetings(spark, sf)
    known = [f"Real-Club-{r[0]}" for r in table(spark, sf, "nation").select("n_nationkey").distinct().collect()]  # a small dimension
    away = F.concat(F.when(F.col("id") % 7 == 0, "Unknown-").otherwise("Real-Club-"), F.col("away"))
    m = m.select("id", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" Real-Club-"), F.col("home"), F.lit("-"), away).alias("key"))
    g = pro.game_key(F.col("key"), known)
    return m.select("id", *[g[c].alias(c) for c in ("day", "home", "away")])


@query("""WITH t AS (SELECT l_orderkey, string_agg(CAST(1 + CAST(l_quantity AS INT) % 5 AS VARCHAR), '-' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS f FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey, string_split(f, '-') AS n FROM t)
  SELECT l_orderkey, CASE WHEN len(n) >= 3 THEN CAST(n[1] AS INT) END AS defence, CASE WHEN len(n) >= 3 THEN CAST(list_sum(list_transform(n[2:len(n) - 1], lambda x: CAST(x AS INT))) AS INT) END AS midfield, CASE WHEN len(n) >= 3 THEN CAST(n[-1] AS INT) END AS attack,
  CAST(o_orderdate AS DATE) AS date, round(o_totalprice / 5000, 2) AS share FROM n JOIN orders ON o_orderkey = l_orderkey""")
def forms_and_dates(spark, sf):
    """Formations of each order's lines, dates of two formats and shares in percent, all read from texts."""
    li = table(spark, sf, "lineitem")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    digits = F.transform(F.sort_array(F.collect_list(line)), lambda x: (1 + x["l_quantity"].cast("int") % 5).cast("string"))
    text = li.groupBy("l_orderkey").agg(F.concat(F.lit(" "), F.array_join(digits, "-"), F.lit(" Attacking")).alias("f"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"), F.concat(F.round(F.col("o_totalprice") / 5000, 2).cast("string"), F.lit(" %")).alias("s"))
    form = fn.formation(F.col("f"))
    percent = fn.number(F.regexp_replace("s", " ", ""))
    return text.join(o, "l_orderkey").select("l_orderkey", *[form[c].alias(c) for c in ("defence", "midfield", "attack")], fn.any_date(F.col("d"), "yyyy-MM-dd", "dd/MM/yyyy").alias("date"), percent.alias("share"))


@query("""WITH s AS (SELECT p_brand AS feature, avg(p_retailprice) AS a, avg(p_size) AS b, min(p_size) AS c FROM part GROUP BY 1),
  m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM s), f AS (SELECT feature, a > ma AS spike, CASE WHEN c < 3 THEN round(b / 50, 6) END AS correlation, c < 3 AND b > mb AS corr, c % 2 = 0 AS probe FROM s, m)
  SELECT feature, CASE WHEN spike AND corr THEN 'leaker' WHEN spike OR corr OR probe THEN 'suspicious' ELSE 'safe' END AS verdict, correlation,
  concat_ws('; ', CASE WHEN spike THEN 'spike' END, CASE WHEN corr THEN 'correlation' END, CASE WHEN probe THEN 'probe' END) AS reasons FROM f""")
def brand_verdicts(spark, sf):
    """Verdicts on each brand from three signals of its parts, of which one lacks some brands."""
    s = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"), F.min("p_size").alias("c"))
    s = s.crossJoin(F.broadcast(s.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))))  # one row
    spikes = s.select("feature", F.col("a").alias("value"), (F.col("a") > F.col("ma")).alias("flagged"))
    correlations = s.where("c < 3").select("feature", F.round(F.col("b") / 50, 6).alias("value"), (F.col("b") > F.col("mb")).alias("flagged"))
    return pro.verdicts(spikes, correlations, s.select("feature", F.col("c").cast("double").alias("value"), (F.col("c") % 2 == 0).alias("flagged")))


GAPS = "(SELECT l_linenumber, l_quantity, CASE WHEN l_linenumber > 2 THEN l_tax END AS tax_after_two, CASE WHEN l_linenumber > 5 THEN l_tax END AS tax_after_five, CASE WHEN l_quantity < 30 THEN l_discount END AS some_discount FROM lineitem)"


@query(f"""SELECT string_agg(c, ',' ORDER BY c) AS features FROM (SELECT 'l_quantity' AS c, avg(CAST(l_quantity IS NULL AS INT)) AS s FROM {GAPS} UNION ALL SELECT 'some_discount', avg(CAST(some_discount IS NULL AS INT)) FROM {GAPS}
  UNION ALL SELECT 'tax_after_five', avg(CAST(tax_after_five IS NULL AS INT)) FROM {GAPS} UNION ALL SELECT 'tax_after_two', avg(CAST(tax_after_two IS NULL AS INT)) FROM {GAPS}) WHERE s <= 0.5""")
def filled_features(spark, sf):
    """Numeric columns that aren't excluded and of which at most half is missing in all lines."""
    li = table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("tax_after_two"), F.when(F.col("l_linenumber") > 5, F.col("l_tax")).alias("tax_after_five"), F.when(F.col("l_quantity") < 30, F.col("l_discount")).alias("some_discount")
    )
    found = ",".join(sorted(pro.feature_columns(li, ["l_linenumber"])))
    return li.agg(F.lit(found).alias("features"))
