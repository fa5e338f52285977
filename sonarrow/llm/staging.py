"""Cutting lineage with Parquet tables in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import scratch

#: Settings of the writes below, of which none changes a result: a written table needs its shuffle files no more, so they
#: go when the write ends; batches sent to Python are small, as executors keep the buffers of the largest.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


class Stage:
    """Tables of one operator run: `put` writes and rereads one, `drop` deletes one that nothing needs any more."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.root = spark, scratch(spark, operator)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        conf = self.spark.conf
        before = {k: conf.get(k) for k in WRITING}
        try:
            for k, v in WRITING.items():
                conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
