"""Shared helpers of the training-data operators: table access, staging, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so any store that Spark reaches will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can clash with them, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def need_whole_ids(df: DataFrame) -> None:
    """doc_ids are compared as numbers: others are refused before anything runs."""
    kind = df.schema["doc_id"].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go with the write, not when the driver next collects its garbage:
    until then those of all steps of a query would lie on disk together."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Written once to the shared folder as Parquet and read back; no shuffle file of the write is left.

    The folder is added to ``paths``, for one who drops it when nothing reads it any more."""
    path = scratch_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def skewed_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, hint: str | None = None) -> DataFrame:
    """Left join with a table of distinct keys, in which ``rows`` tells how many left rows have each.

    Keys of at least a 1024th of the ``total`` left rows, of which there can't be more than 1024,
    are broadcast, so that no task gathers the rows of one; the others are shuffled. ``left`` is
    read twice: stage it before. ``right`` is staged here; ``hint`` is a hint for its rows that aren't hot."""
    right = staged(right, "right")
    hot = F.col(rows) * 1024 >= total
    heads = F.broadcast(right.where(hot))
    cold = right.where(~hot).hint(hint) if hint else right.where(~hot)
    far = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(cold, key, "left")
    return left.join(heads, key).unionByName(far)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of undirected ``edges`` (src, dst).

    Alternates the large-star and small-star steps of the MapReduce algorithm, each a
    grouped minimum and a join, until the edge set stands still. That both steps end, after rounds
    that grow with the square of the nodes' logarithm at most, is proved; so there is no cap on them. A hub's neighbours are never gathered into one row:
    the minimum is pre-aggregated before the shuffle and the join back may be split.
    Nulls and self loops are ignored. Returns (node, component); nodes without an
    edge to another node are not in the result.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself point to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
