"""Queries op2 and op7: a score and a language for every document, by models that the held-out fold never taught."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import langid, toxicity


def fold(n: int = 5):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op2_toxicity_nnpu(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(fold() == 0, F.lit(True))  # a row without id teaches nothing
    model = toxicity.fit(docs, labels, train=~held)
    scored = toxicity.score(docs.select("doc_id", "text"), model, drop=("text",))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold() == 0, F.lit(True))
    model = langid.fit(docs, train_if=~held)
    return langid.predict(docs.select("doc_id", "text"), model, drop=("text",)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_toxicity_nnpu": op2_toxicity_nnpu, "op7_language_id": op7_language_id}
