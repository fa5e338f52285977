"""An exactly-once sink of segments, keyed by query and batch, and what is read from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scratch import scratch


def put(batch: DataFrame, number: int, root: str, query: str, on_segments: Callable[[DataFrame, str, int], None] | None = None) -> None:
    """Write a batch in place of what the same batch of the same query may have left, and then hand it to the callback.

    A batch that is run again after a failure so leaves its rows once. The callback gets the written rows, read back, with
    query and number: it may be called again for a batch, with the same rows, and can tell by these.
    """
    path = f"{root}/query={query}/batch={number}"
    batch.write.mode("overwrite").parquet(path)
    if on_segments is not None:
        on_segments(batch.sparkSession.read.schema(batch.schema).parquet(path), query, number)


def write(stream: DataFrame, root: str, query: str, checkpoint: str, *, mode: str = "append", on_segments: Callable[[DataFrame, str, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start appending a stream's rows under `root`; one checkpoint for each query, triggers as Spark's (availableNow=True).

    Several queries may write under one root. Both folders have to be shared by all executors.
    """
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return w.foreachBatch(lambda batch, number: put(batch, number, root, query, on_segments)).trigger(**trigger).start()


def read(spark: SparkSession, root: str) -> DataFrame:
    """All rows under `root`, with the columns query and batch."""
    return spark.read.option("basePath", root).parquet(f"{root}/query=*")


def drained(stream: DataFrame, query: str) -> DataFrame:
    """The rows that a stream gives for all that is there, by way of a sink of its own."""
    root = scratch(stream.sparkSession, query)
    write(stream, f"{root}/out", query, f"{root}/checkpoint", availableNow=True).awaitTermination()
    return read(stream.sparkSession, f"{root}/out").select(*stream.columns)


def sessions(segments: DataFrame, key: str, order: str, messages: Column) -> DataFrame:
    """(key, session): for each key one JSON array of its messages (an array a row) in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), messages.alias("m"))))
    return segments.groupBy(key).agg(F.to_json(F.flatten(F.transform(rows, lambda r: r["m"]))).alias("session"))
