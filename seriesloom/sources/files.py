"""Sources: CSV files of several dialects, JSON files, pages, made-up rows.

Files are listed and read by Spark only, so any store that Spark reaches will do. What the
driver sees of them is their names and headers, never their rows.
"""

from __future__ import annotations

import csv
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.names import resolve


class MissingColumns(ValueError):
    """A source lacks columns that it must have."""


def require(columns: Sequence[str], names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")


#: Comparisons of a scan's filter.
TESTS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def scan(spark: SparkSession, root: str, name: str, known: Sequence[str], where: Mapping[str, object] | None = None) -> DataFrame:
    """A table of a fixed list of names, filtered; every filter is pushed down to the scan.

    A filter is a value, a list of values of which one holds, or (test, value) pairs that all hold, such as
    ``[(">=", low), ("<", high)]``, or one of them; None and empty ones are skipped, and so are pairs with a value None."""
    if name not in known:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{root}/{name}.parquet")
    for column, value in (where or {}).items():
        if column not in df.columns:
            raise MissingColumns(f"missing columns: {column}")
        pairs = [value] if isinstance(value, tuple) else value
        if value is None or value == "" or value == []:
            continue
        if isinstance(pairs, list) and all(isinstance(v, tuple) for v in pairs):
            for test, bound in pairs:
                if test not in TESTS:
                    raise ValueError(f"unknown test {test}")
                if bound is not None:
                    df = df.where(TESTS[test](F.col(column), F.lit(bound)))
        else:
            df = df.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == F.lit(value))
    return df


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths below root whose file name fits the glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return sorted(r.path for r in files.select("path").collect())


def headers(spark: SparkSession, paths: Sequence[str], encoding: str) -> dict[str, str]:
    """The first line of each file, from the block that begins it."""
    lines = spark.read.option("encoding", encoding).text(list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where("file_block_start = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "n").alias("line"))
    return {r.file_path: r.line for r in first.collect()}


def header_names(line: str, renames: Mapping[str, str] | None = None) -> list[str]:
    """The names of a header line, quoted or not, after renames. A name that comes again gets ``.1``, ``.2`` and so on."""
    names, seen = [], {}
    for c in next(csv.reader([line.lstrip("\ufeff").removeprefix("ï»¿")]), []):
        c = (renames or {}).get(c.strip(), c.strip())
        names.append(f"{c}.{seen[c]}" if c in seen else c)
        seen[c] = seen.get(c, 0) + 1
    return names


def dialect_of(columns: Sequence[str], dialects: Sequence[tuple[Sequence[str], Mapping[str, str]]]) -> Mapping[str, str]:
    """The renames of the first dialect whose marks are all among the columns."""
    return next((names for marks, names in dialects if set(marks) <= set(columns)), {})


def read_csv_files(
    spark: SparkSession,
    root: str,
    dialects: Sequence[tuple[Sequence[str], Mapping[str, str]]] = (),
    required: Sequence[str] = (),
    keep: Mapping[str, Sequence[str]] | None = None,
    path: str = r"([^/_]+)[/_]([^/]+)\.csv$",
    names: Sequence[str] = ("grp", "period"),
    encoding: str = "ISO-8859-1",
    strict: bool = False,
) -> DataFrame:
    """All CSV files below root under one schema of strings, with what their paths say.

    ``path`` takes ``names`` out of each path; files whose values aren't in ``keep`` are not
    read. Files of one header are read together, columns renamed by the dialect that fits, and
    all are put under each other; a column that a file lacks is null. Files without the
    required columns are left out, or an error if ``strict``. No file left: the required columns and
    ``names``, without rows."""
    told = spark.createDataFrame([(f,) for f in list_files(spark, root, "*.csv")], "file string")
    for i, name in enumerate(names):
        told = told.withColumn(name, F.regexp_extract("file", path, i + 1))
        if keep and name in keep:
            told = told.where(F.col(name).isin(list(keep[name])))
    files = [r.file for r in told.where(F.col(names[0]) != "").collect()]
    by_header: dict[str, list[str]] = {}
    for file, line in (headers(spark, files, encoding) if files else {}).items():
        by_header.setdefault(line, []).append(file)
    out = None
    for line, some in sorted(by_header.items()):
        renamed = header_names(line, dialect_of(header_names(line), dialects))
        try:
            require(renamed, required)
        except MissingColumns:
            if strict:
                raise
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in renamed])
        df = spark.read.csv(some, schema=schema, header=True, encoding=encoding, mode="PERMISSIVE", enforceSchema=True)
        df = df.withColumns({n: F.regexp_extract("_metadata.file_path", path, i + 1) for i, n in enumerate(names)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*required, *names]))
    return out


def any_time(text: Column, *formats: str) -> Column:
    """The first format that fits; null if none does. Years of two digits are 1969 to 2068."""
    t = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.when(F.year(t) > 2068, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)


def with_game_key(df: DataFrame, day: Column, home: str, away: str, words: DataFrame | None = None, name: str = "game") -> DataFrame:
    """df with names resolved by a dictionary (see ``operators.names``), if there is one, and the key ``YYYY-MM-DD home-away``; null
    where one of the three is."""
    if words is not None:
        for c in (home, away):
            df = resolve(df, c, words, c)
    return df.withColumn(name, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.col(home), F.lit("-"), F.col(away)))


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as doubles; what is no number is null."""
    return df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in columns if c in df.columns})


def latest_updates(df: DataFrame, version: Sequence[str], update: str) -> DataFrame:
    """Of each version the rows of its largest update; a max per version, joined back."""
    newest = df.groupBy(*version).agg(F.max(update).alias(update))
    return df.join(newest, [*version, update], "left_semi")


def read_envelope(spark: SparkSession, path: str, item: str, keys: Sequence[str]) -> DataFrame:
    """Rows of JSON files that hold a list of items, or an object with the list under one of
    ``keys``; files that can't be read give no rows."""
    text = spark.read.text(path, wholetext=True)
    lists = [F.from_json("value", f"array<{item}>"), *[F.from_json("value", f"struct<`{k}`: array<{item}>>")[k] for k in keys]]
    good = [F.when(F.startswith(F.ltrim("value"), F.lit("[" if i == 0 else "{")), c) for i, c in enumerate(lists)]
    return text.select(F.inline(F.coalesce(*good)))


def flatten_statistics(raw: Column, period: str = "ALL") -> Column:
    """{"statistics": [{"period", "groups": [{"statisticsItems": [{"key", "home", "away"}]}]}]} as a
    map of key_home and key_away of one period; the last item of a key counts."""
    item = "struct<key: string, home: string, away: string>"
    parsed = F.from_json(raw, f"struct<statistics: array<struct<period: string, groups: array<struct<statisticsItems: array<{item}>>>>>>")["statistics"]
    groups = F.flatten(F.transform(F.filter(parsed, lambda p: p["period"] == period), lambda p: p["groups"]))
    items = F.filter(F.flatten(F.transform(groups, lambda g: g["statisticsItems"])), lambda x: x["key"].isNotNull())
    # the text is parsed once: what is needed more often is an argument of a function
    later = lambda a, x: F.concat(F.filter(a, lambda y: y["key"] != x["key"]), F.array(x))
    entry = lambda a, side: F.transform(a, lambda x: F.struct(F.concat(x["key"], F.lit(f"_{side}")).alias("key"), x[side].alias("value")))
    return F.aggregate(items, F.array().cast(f"array<{item}>"), later, lambda a: F.map_from_entries(F.concat(entry(a, "home"), entry(a, "away"))))


def read_cached_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(home, away, day, stats map, broken) of JSON files of two forms: typed records with a date
    text, or raw ones with an epoch; unreadable files give a row that is ``broken``."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    typed = F.from_json("value", "home_team string, away_team string, date string, stats map<string, string>")
    raw = F.from_json("value", "homeTeam string, awayTeam string, startTimestamp long, stats map<string, string>")
    r = text.select(typed.alias("a"), raw.alias("b"))
    day = F.coalesce(F.to_date(F.try_to_timestamp(F.col("a.date"))), F.to_date(F.timestamp_seconds(F.col("b.startTimestamp"))))
    home, away = F.coalesce("a.home_team", "b.homeTeam"), F.coalesce("a.away_team", "b.awayTeam")
    return r.select(home.alias("home"), away.alias("away"), day.alias("day"), F.col("a.stats").alias("stats"), (home.isNull() | away.isNull()).alias("broken"))


def carried_rows(df: DataFrame, key: Sequence[str], html: str, row: str, header: str) -> DataFrame:
    """(key, n, heading, line) of each row of a page's table: ``row`` finds rows, and the text
    that ``header`` takes out of a heading row is carried down to the rows after it."""
    rows = df.select(*key, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("n", "line"))
    rows = rows.withColumn("heading", F.nullif(F.regexp_extract("line", header, 1), F.lit("")))
    down = F.last("heading", ignorenulls=True).over(W.partitionBy(*key).orderBy("n"))
    return rows.withColumn("here", F.col("heading").isNotNull()).withColumn("heading", down).where("not here").drop("here")


def markets_of(element: Column, fields: Mapping[str, str], markets: Sequence[tuple[str, str]]) -> Column:
    """An array of (market, price and all ``fields``) of one page element; empty unless every
    field is there. A market whose price is no number is left out."""
    told = {n: F.nullif(F.trim(F.regexp_extract(element, p, 1)), F.lit("")) for n, p in fields.items()}
    one = [F.struct(F.lit(m).alias("market"), F.regexp_extract(element, p, 1).try_cast("double").alias("price"), *[c.alias(n) for n, c in told.items()]) for m, p in markets]
    whole = F.lit(True)
    for c in told.values():
        whole = whole & c.isNotNull()
    return F.when(whole, F.filter(F.array(*one), lambda x: x["price"].isNotNull())).otherwise(F.slice(F.array(*one), 1, 0))


def made_up(spark: SparkSession, rows: int, features: int, labels: int, seed: int, groups: Sequence[str]) -> DataFrame:
    """Normal features, uniform labels and odds in [1.5, 5), and a group; the same for a seed and number of rows."""
    u = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "id"), F.lit(2**53)) / float(2**53)
    normal = lambda n: F.sqrt(-2 * F.ln(u(2 * n) + 2.0**-53)) * F.cos(2 * F.pi() * u(2 * n + 1))
    df = spark.range(rows)
    some = F.element_at(F.array(*[F.lit(g) for g in groups]), (F.floor(u(-3) * len(groups)) + 1).cast("int"))
    return df.select("id", *[normal(n).alias(f"x{n}") for n in range(features)], F.floor(u(-1) * labels).cast("int").alias("label"), (1.5 + 3.5 * u(-2)).alias("odds"), some.alias("grp"))
