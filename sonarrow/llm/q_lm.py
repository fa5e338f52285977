"""Query op5: class-based and unigram scores of all documents, learned from four folds of five."""

from __future__ import annotations

from pyspark.sql import functions as F

from .lm import lm_scores
from .q_classify import fold


def op5_brown_lm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold() == 1, F.lit(True))  # a row without id teaches nothing
    return lm_scores(docs.withColumn("held_out", held), ~F.col("held_out"))


QUERIES = {"op5_brown_lm": op5_brown_lm}
