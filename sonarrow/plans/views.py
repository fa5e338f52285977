"""The tables that queries derive from the driver's, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tables import table


def signal(spark, sf_dir):
    """events as (user_id, i, x), i from 0 in order of time."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.cast("long").alias("i"), F.col("value").alias("x"))


SIGNAL = "signal AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"


def vectors(spark, sf_dir):
    """embeddings as (vec_id, label, x array<double>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def tensor(spark, sf_dir):
    """embeddings as (vec_id, label, pos, v)."""
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("pos", "v"))


TENSOR = "tensor AS (SELECT vec_id, label, p - 1 AS pos, CAST(embedding[p] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"


def tokens(spark, sf_dir):
    """events as a token stream (user_id, i, is_ts, tok, x): errors and signups are time tokens 0.02 s apart."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.cast("long").alias("i"), F.col("event_type").isin("error", "signup").alias("is_ts"), (F.col("event_id") % 100).alias("tok"), F.col("value").alias("x"))


TOKENS = "tokens AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type IN ('error', 'signup') AS is_ts, event_id % 100 AS tok, value AS x FROM events)"


def segments(spark, sf_dir):
    """conversations as timed segments (conv_id, turn, role, t0, t1, text): 0.05 s for each character."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "turn", "role", (before * 0.05).alias("t0"), ((before + n) * 0.05).alias("t1"), "text")


SEGMENTS = """segments AS (SELECT conv_id, turn, role, b * 0.05::DOUBLE AS t0, (b + n) * 0.05::DOUBLE AS t1, text FROM (SELECT *, length(text) AS n,
  coalesce(CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b FROM conversations))"""
