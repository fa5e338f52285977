"""Query op1: the whole of `documents` mixed to weighted targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .mixing import mix


def op1_mix_sources(spark, sf_dir):
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op1_mix_sources": op1_mix_sources}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest, coalesce('s' || source, 'n') AS key FROM documents),
s AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source, key),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS lim FROM k),
f AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
             sum(weight) OVER (ORDER BY lim / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM w),
g AS (SELECT *, (total - full_) / open_ >= lim / weight AS stopped FROM f),
t AS (SELECT key, source_size, CASE WHEN stopped THEN lim ELSE weight * max(CASE WHEN NOT stopped THEN (total - full_) / open_ END) OVER () END AS target,
             CAST('0x' || substr(md5(key), 1, 5) AS BIGINT)::DOUBLE / 1048576 AS off FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.off,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY d.key ORDER BY lpad(CAST(length(printf('%X', d.size)) AS VARCHAR), 2, '0') || substr(printf('%X', d.size), 1, 2),
                                substr(digest, 1, 2), d.size, digest) - 1 AS i
      FROM d JOIN t USING (key)),
c AS (SELECT *, CAST(floor((i + 1) * rate + off) - floor(i * rate + off) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
}
