"""Query op6: the 20 nearest of every embedding whose vec_id is divisible by 20, among all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .neighbours import nearest


def op6_hnsw_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_hnsw_neighbours": op6_hnsw_neighbours}
