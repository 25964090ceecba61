"""Tables on a file store that change as a whole or not at all.

A table is a folder of data that is only ever added to, and a folder ``versions`` of small lists. Each list names, bucket by
bucket, the data folders that make up one version. A change writes its data first and its list last, under a name of
its own, and then renames the list to the next number, which the store does at once and only if no other writer took that
number. Whatever breaks before leaves the last version as it was; data that no list names is never read.

An upsert reads and writes only the buckets that hold keys of its batch; all others stay in their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relations import latest, upsert

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published the next version first."""


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, fs = file_system(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n) for n in names if n.isdigit())


def _listed(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{number}", wholetext=True).first()[0])


def current(spark: SparkSession, path: str) -> dict | None:
    """The list of the last version: its number, schema and the folder of each bucket."""
    numbers = _numbers(spark, path)
    return _listed(spark, path, numbers[-1]) if numbers else None


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def _frame(spark: SparkSession, path: str, told: dict, buckets: Sequence[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(told["schema"])
    folders = sorted({f"{path}/{f}" for b, f in told["folders"].items() if buckets is None or b in buckets})
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of a table, or an older one; a folder that this module didn't write is read as Parquet."""
    told = current(spark, path) if version is None else _listed(spark, path, version)
    return spark.read.parquet(path) if told is None else _frame(spark, path, told)


def _commit(spark: SparkSession, path: str, folders: dict[str, str], schema: T.StructType, after: int) -> int:
    """Publishes a list as the version that follows ``after``."""
    told = json.dumps({"version": after + 1, "schema": schema.jsonValue(), "folders": folders}, sort_keys=True)
    ready, fs = file_system(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(ready, False)
    out.write(bytearray(told.encode()))
    out.close()
    place, _ = file_system(spark, f"{path}/versions/{after + 1}")
    if fs.exists(place) or not fs.rename(ready, place):
        fs.delete(ready, False)
        raise Conflict(f"{path}: version {after + 1} is there already")
    return after + 1


def _last(told: dict | None) -> int:
    return told["version"] if told else 0


def replace(df: DataFrame, path: str, by: Sequence[str] = ()) -> int:
    """A version of these rows alone, in folders by the ``by`` columns."""
    spark, told, folder = df.sparkSession, current(df.sparkSession, path), f"data/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/{folder}")
    return _commit(spark, path, {folder: folder}, df.schema, _last(told))


def append(df: DataFrame, path: str) -> int:
    """A version with these rows too; columns are united and no file is rewritten."""
    spark, told, folder = df.sparkSession, current(df.sparkSession, path), f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    old = T.StructType.fromJson(told["schema"]) if told else T.StructType()
    return _commit(spark, path, {**(told["folders"] if told else {}), folder: folder}, _united(old, df.schema), _last(told))


def _united(old: T.StructType, new: T.StructType) -> T.StructType:
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in old.names]])


def change(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = (), mode: str = "last", bucket: Column | None = None, buckets: int = 64) -> int:
    """A version in which the rows of ``df`` have met those of the same key.

    mode ``last``: of old and new rows the one that is last by ``order`` stays, the new one among equals; columns are united.
    ``replace``: the new row counts as a whole; ``merge``: columns that it lacks keep their old values; in both, of new rows with one key the
    last by ``order``. ``bucket`` must follow from the key (such as its season) and be the same in every call; by default it is a
    hash of the key. Its distinct values in a batch are known to the driver, so they must be few."""
    spark, told = df.sparkSession, current(df.sparkSession, path)
    mark = lambda d: d.withColumn(BUCKET, F.coalesce((F.pmod(F.xxhash64(*key), F.lit(buckets)) if bucket is None else bucket).cast("string"), F.lit("none")))
    touched = [r[0] for r in mark(df).select(BUCKET).distinct().collect()]
    if not touched and told:
        return _last(told)
    if told:
        old = _frame(spark, path, told, touched)
        for f in [f for f in df.schema.fields if f.name not in old.columns]:
            old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
        out = latest(old, df, key, order) if mode == "last" else upsert(old, df, key, mode, order)
    else:
        out = latest(df.limit(0), df, key, order)
    folder = f"data/{uuid.uuid4().hex}"
    # one task writes a bucket, so that it is one file unless it is large
    mark(out).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    base, fs = file_system(spark, f"{path}/{folder}")
    written = [s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()]
    kept = {b: f for b, f in (told["folders"] if told else {}).items() if b not in touched}
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    added = {names.unescapePathName(n.split("=", 1)[1]): f"{folder}/{n}" for n in written}
    return _commit(spark, path, {**kept, **added}, out.schema, _last(told))


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes lists and data that none of the last ``keep`` versions needs; how many folders went.

    A writer that is at work meanwhile would lose what it has written: call it while there is none."""
    numbers = _numbers(spark, path)
    needed = {f for n in numbers[-keep:] for f in _listed(spark, path, n)["folders"].values()}
    for n in numbers[:-keep]:
        p, fs = file_system(spark, f"{path}/versions/{n}")
        fs.delete(p, False)
    gone = 0
    root, fs = file_system(spark, f"{path}/data")
    for folder in [s.getPath() for s in fs.listStatus(root)]:
        parts = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
        here = f"data/{folder.getName()}"
        if here in needed:
            continue
        used = [p for p in parts if f"{here}/{p.getName()}" in needed]
        for p in [p for p in parts if p not in used] if used else [folder]:
            fs.delete(p, True)
            gone += 1
    return gone
