"""Query op3: every document's payload, stored as JPEG and read back."""

from __future__ import annotations

from .media import digests


def op3_jpeg_media(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",))


QUERIES = {"op3_jpeg_media": op3_jpeg_media}
