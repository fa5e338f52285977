"""Query op12: every document's token ids, and the text they decode to."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import decode, encode


def op12_bpe_encode(spark, sf_dir):
    d = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",)))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


QUERIES = {"op12_bpe_encode": op12_bpe_encode}
