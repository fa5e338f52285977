"""Query op4: every row of `pages` against a dated list, as of its fetch day.

The tables hold neither fetch times nor lists, so both are derived, by fixed rules over MD5, from the whole table: a
capture's day from its page_id, and the history of every host, parent domain and host with path from the key itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .url_lists import evaluate, host_of, keys_of, path_of


def _hex(col, at, n):
    return F.conv(F.substring(F.md5(col), at, n), 16, 10).cast("int")


def _list(captures):
    keys = captures.select(F.explode(keys_of(host_of(F.col("url")), path_of(F.col("url")))).alias("key")).groupBy("key").agg(F.lit(1).alias("one"))
    k = F.col("key")
    d1 = F.date_add(F.lit("2024-01-01").cast("date"), _hex(k, 2, 3) % 300)
    d2 = F.date_add(d1, _hex(k, 5, 2) % 200 + 30)
    d3 = F.date_add(d2, _hex(k, 7, 2) % 100 + 10)
    d4 = F.date_add(d3, F.lit(60))
    first, third, fourth = _hex(k, 1, 1) < 8, _hex(k, 9, 1) < 8, _hex(k, 10, 1) < 8
    entry = lambda day, listed, when: F.when(when, F.struct(day.alias("day"), F.lit(listed).alias("listed")))
    history = F.array(entry(d1, True, first), entry(d2, False, first), entry(d3, True, first & third), entry(d4, False, first & third & fourth))
    return keys.select("key", F.inline(F.filter(history, lambda x: x.isNotNull())))


def op4_temporal_url_list(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), _hex(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 1, 4) % 730)
    found = evaluate(pages.withColumn("fetched", day), _list(pages))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select("page_id", "host", text("fetched").alias("fetched"), (F.col("n_active") > 0).cast("int").alias("blocked"), "n_active", "entry_key", text("entry_from").alias("entry_from"))


QUERIES = {"op4_temporal_url_list": op4_temporal_url_list}

ORACLE_SQL = {
    "op4_temporal_url_list": r"""
WITH p AS (SELECT page_id, lower(coalesce(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1), '\.$', ''), '')) AS host,
                  coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+)', 1), '') AS path,
                  DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 4) AS INT) % 730 AS INT) AS day FROM pages),
c AS (SELECT DISTINCT host, path, day FROM p WHERE host <> ''),
hp AS (SELECT DISTINCT host, path FROM c),
pk AS (SELECT host, path, array_to_string(l[i:], '.') AS key FROM (SELECT host, path, string_split(host, '.') AS l, unnest(range(1, CASE WHEN regexp_full_match(host, '\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3}') THEN 2 ELSE greatest(len(string_split(host, '.')), 2) END)) AS i FROM hp)
       UNION ALL SELECT host, path, host || path FROM hp WHERE path <> ''),
m AS (SELECT key, md5(key) AS h FROM (SELECT DISTINCT key FROM pk)),
x AS (SELECT key, CAST('0x' || h[1:1] AS INT) < 8 AS a, CAST('0x' || h[9:9] AS INT) < 8 AS b, CAST('0x' || h[10:10] AS INT) < 8 AS e,
             DATE '2024-01-01' + CAST('0x' || h[2:4] AS INT) % 300 AS d1, CAST('0x' || h[5:6] AS INT) % 200 + 30 AS n2, CAST('0x' || h[7:8] AS INT) % 100 + 10 AS n3 FROM m),
y AS (SELECT key, d1 AS f, d1 + n2 AS t FROM x WHERE a UNION ALL
      SELECT key, d1 + n2 + n3, CASE WHEN e THEN d1 + n2 + n3 + 60 END FROM x WHERE a AND b),
z AS (SELECT c.host, c.path, c.day, count(*) AS n_active, max({'n': length(pk.key), 'k': pk.key, 'f': y.f}) AS top
      FROM c JOIN pk USING (host, path) JOIN y ON y.key = pk.key AND c.day >= y.f AND (y.t IS NULL OR c.day < y.t) GROUP BY ALL)
SELECT p.page_id, p.host, strftime(p.day, '%Y-%m-%d') AS fetched, CAST(coalesce(n_active, 0) > 0 AS INT) AS blocked, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active,
       top.k AS entry_key, strftime(top.f, '%Y-%m-%d') AS entry_from
FROM p LEFT JOIN z USING (host, path, day)
"""
}
