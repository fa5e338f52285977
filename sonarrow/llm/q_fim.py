"""Query op13: every document for filling in the middle, and restored from that."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fim import fill_in_middle, restore


def op13_fill_in_middle(spark, sf_dir):
    d = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",)))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return d.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest("fim_text").alias("output_sha256"), digest("restored").alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLE_SQL = {
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, t, n, form, least(x, y) AS p, greatest(x, y) - least(x, y) AS m FROM h),
o AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, m) AS middle, substr(t, p + m + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o"""
}
