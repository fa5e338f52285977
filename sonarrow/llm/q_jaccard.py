"""Query op9: 3-word shingle sets at a Jaccard similarity of 0.9, all documents."""

from __future__ import annotations

from .jaccard import join_components


def op9_jaccard_join(spark, sf_dir):
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
