"""Event-time windows over a stream, the same expressions as in batch, and running a stream over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch


def hops(events: DataFrame, size: str, hop: str, late: str | None = None) -> DataFrame:
    """(window, n, total) of events (ts, value); with `late`, what comes later than that is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", size, hop).alias("window")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(*keys, F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that match `path`."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over all that is there and give its final rows: of each key those of the last batch that had it.

    Every batch is written to the shared folder with its number, and so is the query's checkpoint, so a restart goes on.
    """
    spark = stream.sparkSession
    root = scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out").drop("batch")
    last = out.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return out.join(last, [*keys, "_batch"]).drop("_batch")
