"""Incremental loads with Structured Streaming: each file is read once, each batch is an upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import append_keep_last


def ingest(spark: SparkSession, source: str, schema: str, target: str, key: Sequence[str], order: Sequence[str], checkpoint: str, files_each: int = 1000, **how) -> None:
    """Brings all Parquet files below ``source`` that no earlier call has seen into ``target``, of each
    key the last row by ``order``, whichever file it came with. The checkpoint remembers files; a batch that is
    repeated after a failure changes nothing, as it holds the same rows, and a batch rewrites only the buckets
    of the target that hold its keys (``how``: see ``versions.change``)."""

    def batch(df: DataFrame, _: int) -> None:
        append_keep_last(df, target, key, order, **how)

    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    read.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
