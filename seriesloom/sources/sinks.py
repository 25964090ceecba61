"""Sinks: tables that are overwritten, appended, upserted or published as a whole.

Tables are kept in versions (``versions.py``): a change is seen as a whole or not at all, and is read with ``read_table``.
Documents and JSON, which others read by their path, are written beside it and renamed into its place.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .versions import file_system

read_table = versions.read


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def recover(spark: SparkSession, target: str) -> None:
    """Brings back what a publication that broke off had set aside."""
    (old, fs), (aside, _) = file_system(spark, target), file_system(spark, f"{target}.aside")
    if fs.exists(aside) and not fs.exists(old) and not fs.rename(aside, old):
        raise OSError(f"could not bring back {target}")


def publish(spark: SparkSession, ready: str, target: str) -> None:
    """Puts a finished folder in the place of another, which is set aside until then.

    These are two renames. If the driver dies between them, the old folder lies in ``target.aside``; the next call, or
    ``recover``, brings it back first."""
    (new, fs), (old, _), (aside, _) = (file_system(spark, p) for p in (ready, target, f"{target}.aside"))
    if not fs.exists(new):
        raise FileNotFoundError(ready)
    recover(spark, target)
    fs.mkdirs(old.getParent())
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"could not set {target} aside")
    if not fs.rename(new, old):
        recover(spark, target)
        raise OSError(f"could not publish {target}")
    fs.delete(aside, True)


def overwrite(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The whole table anew, in folders by the ``by`` columns, published at once."""
    versions.replace(df, path, by)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table, or no rows of the form of ``like`` if it was never written."""
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return like.limit(0)


def append_keep_last(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = (), **how) -> None:
    """Adds rows; of each key only the last row by ``order`` stays, over old and new ones, and of equals (or without an
    order) the new one. Columns are united; only buckets that hold keys of ``df`` are rewritten (``how``: see
    ``versions.change``). Without all key columns rows are only added."""
    told = versions.current(df.sparkSession, path)
    there = [f["name"] for f in told["schema"]["fields"]] if told else df.columns
    if set(key) <= set(there) & set(df.columns):
        versions.change(df, path, key, order, "last", **how)
    else:
        versions.append(df, path)


def store(df: DataFrame, path: str, columns: Sequence[str], key: Sequence[str], renames: Mapping[str, str] | None = None, order: Sequence[str] = (), **how) -> None:
    """Upserts those of a table's columns that ``df`` has, after renames; others keep what is there. Of rows that
    repeat a key the last by ``order`` counts."""
    df = df.withColumnsRenamed(dict(renames or {}))
    versions.change(df.select([c for c in columns if c in df.columns]), path, key, [c for c in order if c in columns], "merge", **how)


LEDGER = "source string, grp string, period string, at timestamp, n long, status string"


class Ledger:
    """What has been loaded: the last row of each (source, grp, period) tells its status."""

    KEY = ("source", "grp", "period")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.spark.createDataFrame([], LEDGER))

    def record(self, df: DataFrame) -> None:
        """Statuses of later loads; one that came late never hides a newer one."""
        append_keep_last(df.select([c.split()[0] for c in LEDGER.split(", ")]), self.path, self.KEY, ["at"], buckets=4)

    def unread(self, wanted: DataFrame) -> DataFrame:
        """The wanted keys that have not been loaded with success."""
        return wanted.join(self.rows().where("status = 'success'"), list(self.KEY), "left_anti")

    def forget(self, what: Column) -> None:
        """Deletes rows, such as by period or by ``source LIKE``."""
        overwrite(self.rows().where(~F.coalesce(what, F.lit(False))), self.path)


def write_json(df: DataFrame, path: str, about: Mapping[str, Sequence[str]] | None = None) -> None:
    """Rows as JSON lines with sorted fields, nulls kept, and beside them one line about the table: its numbers of
    rows and columns, and the distinct values of the named columns."""
    spark = df.sparkSession
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}.next")
    publish(spark, f"{path}.next", path)
    named = [c for names in (about or {}).values() for c in names]
    facts = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), *[F.sort_array(F.collect_set(c)).alias(c) for c in named])
    facts.coalesce(1).write.mode("overwrite").json(f"{path}.about")


def write_text(spark: SparkSession, path: str, told: dict) -> None:
    """A small document, written beside its place and renamed into it."""
    spark.createDataFrame([(json.dumps(told, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.next")
    publish(spark, f"{path}.next", path)


def copy_missing(df: DataFrame, path: str, key: Sequence[str]) -> tuple[int, int]:
    """Appends the rows whose key the target lacks, one for each key; (rows of the target before, after)."""
    there = read_or_empty(df.sparkSession, path, df)
    before = there.count()
    versions.append(df.join(there, list(key), "left_anti").dropDuplicates(list(key)), path)
    return before, read_table(df.sparkSession, path).count()
