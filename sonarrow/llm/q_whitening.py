"""Query op11: all embeddings whitened, a row for each of the first eight components."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import whitening as w


def op11_whiten_embeddings(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = w.fit(d)
    error = w.identity_error(d, model)
    rows = w.by_component(w.apply(d, model, drop=("embedding",)), model)
    # a deviation beyond 64 bits, which takes some millions of vectors, is null as a long
    return rows.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))


QUERIES = {"op11_whiten_embeddings": op11_whiten_embeddings}
