"""Queries op8 and op10: token counts and packed sequences of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .packing import pack
from .viterbi import count_tokens


def op8_unigram_counts(spark, sf_dir):
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",))


def op10_pack_sequences(spark, sf_dir):
    p = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_unigram_counts": op8_unigram_counts, "op10_pack_sequences": op10_pack_sequences}
