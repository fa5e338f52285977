"""Queries that take streams in order, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequential as Q
from ..operators import spectra
from ..operators import timeline as L
from ..streaming import windows
from ..tables import table
from .catalog import query
from .views import SIGNAL, TENSOR, TOKENS, signal, tensor, tokens, vectors

R = lambda c: F.round(c, 6)


def _spans_sql(least: int, quiet: int, brief: int, most: int) -> str:
    """Padded spans by one recursive step for each span: it opens at s, and its silences are those of the hushed windows from p on.

    A silence is counted from the first hushed window after the loud window before it. The span ends with the first hushed
    window that is `quiet` beyond that; it is split at its first window of over `most`, if that comes no later, where the last
    silence of over `brief` begins, or on the spot. The next one opens with the next loud window, or goes on from the one
    after the silence that it was split at.
    """
    return f"""WITH RECURSIVE {SIGNAL}, pr AS (SELECT user_id, i, x / 300.0 >= 0.5 AS up, x / 300.0 < 0.35 AS down, count(*) OVER (PARTITION BY user_id) AS n FROM signal),
nu AS (SELECT *, min(CASE WHEN up THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_up, max(CASE WHEN up THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS prev_up FROM pr),
hushed AS (SELECT user_id, i, prev_up FROM nu WHERE down AND prev_up IS NOT NULL),
z AS (SELECT user_id, n, min(i) AS s, min(i) AS p, NULL::BIGINT AS es, NULL::BIGINT AS ee FROM pr WHERE up GROUP BY user_id, n
UNION ALL SELECT t.user_id, t.n, nu.next_up, CASE WHEN t.how = 'cut' AND nu.next_up <= t.late THEN t.late ELSE nu.next_up END, CASE WHEN t.counts THEN t.s END, CASE WHEN t.counts THEN t.stop END
 FROM (SELECT *, how IN ('cut', 'late') OR stop - s > {least} AS counts FROM (SELECT *, CASE how WHEN 'end' THEN hush WHEN 'cut' THEN cut WHEN 'late' THEN late ELSE n END AS stop, CASE how WHEN 'end' THEN done WHEN 'cut' THEN cut WHEN 'late' THEN late + 1 END AS look
  FROM (SELECT *, CASE WHEN done < late THEN 'end' WHEN late >= n THEN 'over' WHEN cut IS NULL THEN 'late' ELSE 'cut' END AS how
   FROM (SELECT user_id, n, s, late, min(CASE WHEN i - h >= {quiet} THEN i END) AS done, arg_min(h, CASE WHEN i - h >= {quiet} THEN i END) AS hush, max(CASE WHEN i - h > {brief} AND i < late THEN h END) AS cut
    FROM (SELECT z.user_id, z.n, z.s, greatest(z.p, z.s + {most} + 1) AS late, q.i, min(q.i) OVER (PARTITION BY z.user_id, q.prev_up) AS h FROM z LEFT JOIN hushed q ON q.user_id = z.user_id AND q.prev_up >= z.s AND q.i >= z.p WHERE z.s IS NOT NULL) GROUP BY user_id, n, s, late)))) t
 LEFT JOIN nu ON nu.user_id = t.user_id AND nu.i = t.look),
f AS (SELECT user_id, n, es AS s, ee AS e FROM z WHERE ee IS NOT NULL),
g AS (SELECT *, row_number() OVER w AS k, s - lag(e) OVER w AS before, lead(s) OVER w - e AS after FROM f WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, k, CAST(CASE WHEN before IS NULL THEN greatest(0, s - 1) WHEN before < 2 THEN s - before // 2 ELSE s - 1 END AS BIGINT) AS start, CAST(CASE WHEN after IS NULL THEN least(n, e + 1) WHEN after < 2 THEN e + after // 2 ELSE e + 1 END AS BIGINT) AS end FROM g"""


def _spans(spark, d, rate, **options):
    s = signal(spark, d).withColumn("p", F.col("x") / 300.0)
    n = s.groupBy("user_id").agg(F.count("*").alias("n"))
    spans = Q.vad_segments(s, ["user_id"], "p", 1, rate, **options)
    return L.pad(spans.join(n, "user_id"), ["user_id"], 1, F.col("n")).select("user_id", "k", "start", "end")


@query("vad_segments_full", _spans_sql(1, 2, 98, 20))
def vad_segments_full(spark, d):
    return _spans(spark, d, 1000, min_speech_ms=1, min_silence_ms=2, max_speech_s=0.02)


@query("vad_segments_split", _spans_sql(0, 4, 1, 6))
def vad_segments_split(spark, d):
    """The same with silences that are long enough to split at before they end a span."""
    return _spans(spark, d, 20, min_speech_ms=10, min_silence_ms=200, max_speech_s=0.3)


@query("dtw_align")
def dtw_align(spark, d):
    """Each embedding's 64 values as tokens warped onto the next one's 64 values, by the least absolute difference."""
    v = vectors(spark, d).select("vec_id", "x")
    both = v.withColumnRenamed("x", "a").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("b")), "vec_id")
    return Q.warped(both, ["vec_id"], "a", "b")


@query(
    "feed_windows",
    f"""WITH RECURSIVE {TOKENS}, n AS (SELECT user_id, count(*) AS n FROM tokens GROUP BY user_id),
a AS (SELECT t.user_id, t.i, least(30, n - t.i) AS length, coalesce(max(CASE WHEN is_ts THEN t.i END) OVER w - t.i + 1, 0) AS mark, avg(x) OVER w AS mean, n FROM tokens t JOIN n USING (user_id) WINDOW w AS (PARTITION BY t.user_id ORDER BY t.i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
g AS (SELECT user_id, i, length, least(CASE WHEN mark >= 5 THEN mark ELSE 30 END, length) AS go, mean FROM a WHERE length = 30 OR length > 2),
z AS (SELECT user_id, i, length, go, mean FROM g WHERE i = 0 UNION ALL SELECT g.user_id, g.i, g.length, g.go, g.mean FROM z JOIN g ON g.user_id = z.user_id AND g.i = z.i + z.go)
SELECT user_id, i AS start, CAST(length AS BIGINT) AS length, CAST(go AS BIGINT) AS advance, round(mean, 6) AS mean FROM z""",
)
def feed_windows(spark, d):
    """Streams of tokens fed in windows of 30 that move on to their last time token; tails of over 2 are decoded at the end."""
    return Q.feed_windows(tokens(spark, d), ["user_id"], "x", "is_ts", 30, 5, 2).withColumn("mean", R("mean"))


@query(
    "stream_windows",
    "WITH h AS (SELECT value, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS s, unnest(range(0, 4)) AS k FROM events) SELECT (s - k) * 3600 AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY s - k",
)
def stream_windows(spark, d):
    """The batch query sliding_hop_window, run as a stream; without a watermark, as files may come in any order of time."""
    h = windows.hops(windows.file_stream(spark, f"{d}/events.parquet"), "4 hours", "1 hour")
    out = windows.drain(h.select(F.unix_timestamp("window.start").alias("start_s"), "n", "total"), ["start_s"])
    return out.select("start_s", "n", F.round("total", 4).alias("total"))


HEADS = f"""{TENSOR}, h AS (SELECT vec_id, vec_id // 3 AS win, vec_id % 3 AS head FROM embeddings), w AS (SELECT win, head, pos // 16 AS token, pos % 16 AS time, v FROM tensor JOIN h USING (vec_id)),
z AS (SELECT win, head, token, time, (v - avg(v) OVER c) / sqrt(var_pop(v) OVER c + 1e-9) AS v FROM w WINDOW c AS (PARTITION BY win, head, time)),
o AS (SELECT win, head, token, time, CASE WHEN time + o < 0 THEN -(time + o) WHEN time + o > 15 THEN 30 - time - o ELSE time + o END AS at FROM z, (SELECT unnest(range(-3, 4)) AS o)),
m AS (SELECT o.win, o.head, o.token, o.time, median(z.v) AS v FROM o JOIN z ON z.win = o.win AND z.head = o.head AND z.token = o.token AND z.time = o.at GROUP BY ALL)"""


def _heads(spark, d):
    """Three embeddings after one another as a window's heads, each of 4 tokens by 16 times."""
    t = tensor(spark, d)
    return t.select(F.expr("vec_id div 3").alias("win"), (F.col("vec_id") % 3).alias("head"), F.floor(F.col("pos") / 16).alias("token"), (F.col("pos") % 16).cast("long").alias("time"), F.col("v").alias("w"))


@query("heads_cost", f"WITH {HEADS} SELECT win, CAST(token AS BIGINT) AS token, CAST(time AS BIGINT) AS time, round(-avg(v), 6) AS cost FROM m GROUP BY win, token, time")
def heads_cost(spark, d):
    """Attention of several heads as the cost of an alignment."""
    return spectra.heads_cost(_heads(spark, d), ["win"], 16).select("win", "token", "time", F.round("cost", 6).alias("cost"))


@query("token_onsets")
def token_onsets(spark, d):
    """When each token begins, by aligning the heads' cost; too far from SQL, so tests hold it against brute force."""
    return spectra.token_onsets(_heads(spark, d), ["win"], 16)
