"""Activity segments, token streams, cropping, splitting and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as L
from ..tables import table
from .catalog import query
from .views import SEGMENTS, SIGNAL, TENSOR, TOKENS, segments, signal, tensor, tokens

R = lambda c: F.round(c, 6)

ISLANDS = f"""{SIGNAL}, probs AS (SELECT user_id, i, x / 300.0 AS p FROM signal),
st AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN 1 WHEN p < 0.35 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS on_ FROM probs),
ed AS (SELECT *, CASE WHEN on_ = 1 AND coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS o FROM st),
isl AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS k FROM ed),
hyst AS (SELECT user_id, k, min(i) AS s, max(i) + 1 AS e FROM isl WHERE on_ = 1 GROUP BY user_id, k),
len AS (SELECT user_id, count(*) AS n FROM signal GROUP BY user_id),
gaps AS (SELECT h.*, n, s - lag(e) OVER (PARTITION BY user_id ORDER BY k) AS b, lead(s) OVER (PARTITION BY user_id ORDER BY k) - e AS a FROM hyst h JOIN len USING (user_id)),
padded AS (SELECT user_id, k, n, CASE WHEN b IS NULL THEN greatest(0, s - 3) WHEN b < 6 THEN s - b // 2 ELSE s - 3 END AS s, CASE WHEN a IS NULL THEN least(n, e + 3) WHEN a < 6 THEN e + a // 2 ELSE e + 3 END AS e FROM gaps),
crop AS (SELECT *, least(e + 2, n) AS ce, CAST(coalesce(sum(least(e + 2, n) - s + 5) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS processed FROM padded)"""


def islands(spark, d):
    return L.hysteresis(signal(spark, d).withColumn("p", F.col("x") / 300.0), ["user_id"], "p")


def padded(spark, d):
    n = signal(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return L.pad(islands(spark, d).join(n, "user_id"), ["user_id"], 3, F.col("n"))


def cropped(spark, d):
    return L.crop_map(padded(spark, d), ["user_id"], 5, 2, F.col("n"))


@query("hysteresis_segments", f"WITH {ISLANDS} SELECT user_id, k, s AS start, e AS \"end\" FROM hyst")
def hysteresis_segments(spark, d):
    return islands(spark, d).select("user_id", "k", "start", "end")


@query("pad_segments", f"WITH {ISLANDS} SELECT user_id, k, s AS start, e AS \"end\" FROM padded")
def pad_segments(spark, d):
    return padded(spark, d).select("user_id", "k", "start", "end")


@query("crop_and_map", f"WITH {ISLANDS} SELECT user_id, k, s AS original, ce AS cut_end, processed FROM crop")
def crop_and_map(spark, d):
    return cropped(spark, d).select("user_id", "k", F.col("start").alias("original"), "cut_end", "processed")


@query(
    "map_time_asof",
    f"""WITH {ISLANDS}, f AS (SELECT user_id, min_by(processed, processed) AS p0, min_by(s, processed) AS o0 FROM crop GROUP BY user_id)
SELECT g.user_id, g.i, g.i - coalesce(c.processed, p0, 0) + coalesce(c.s, o0, 0) AS original FROM signal g ASOF LEFT JOIN crop c ON g.user_id = c.user_id AND g.i >= c.processed LEFT JOIN f ON f.user_id = g.user_id""",
)
def map_time_asof(spark, d):
    anchors = cropped(spark, d).select("user_id", "processed", F.col("start").alias("original"))
    return L.original_time(signal(spark, d).select("user_id", "i"), anchors, ["user_id"], "i")


@query(
    "parse_segments",
    f"""WITH {TOKENS}, r AS (SELECT *, sum(is_ts::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM tokens),
g AS (SELECT user_id, run, min(i) AS start_i, CAST(sum((NOT is_ts)::INT) AS BIGINT) AS n_text FROM r WHERE run > 0 GROUP BY user_id, run),
h AS (SELECT *, lead(start_i) OVER (PARTITION BY user_id ORDER BY run) AS end_i, coalesce(sum((n_text = 0)::INT) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, st ORDER BY run) AS k FROM h WHERE n_text > 0) SELECT user_id, start_i, coalesce(end_i, -1) AS end_i, n_text FROM q WHERE k % 2 = 1""",
)
def parse_segments(spark, d):
    return L.parse_segments(tokens(spark, d), ["user_id"]).withColumn("end_i", F.coalesce("end_i", F.lit(-1)))


@query(
    "token_times",
    """WITH w AS (SELECT conv_id, turn, k - 1 AS k, l[k] AS word, 10.0::DOUBLE + turn AS t0, 12.5::DOUBLE + turn AS t1 FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations))),
s AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn) AS t, coalesce(sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w)
SELECT conv_id, turn, k, word, round(CASE WHEN t > 0 THEN t0 + (t1 - t0) * b / t ELSE t0 END, 6) AS w0, round(CASE WHEN t > 0 THEN t0 + (t1 - t0) * (b + length(word)) / t ELSE t1 END, 6) AS w1 FROM s""",
)
def token_times(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "word")).withColumn("k", F.col("k").cast("long"))
    return L.token_times(w, ["conv_id", "turn"], F.col("turn") + 10.0, F.col("turn") + 12.5).select("conv_id", "turn", "k", "word", R("w0").alias("w0"), R("w1").alias("w1"))


@query(
    "split_by_char",
    f"""WITH {SEGMENTS}, p AS (SELECT *, unnest(range(0, (length(text) - 1) // 40 + 1)) AS part FROM segments WHERE length(text) > 0)
SELECT conv_id, turn, CAST(part AS BIGINT) AS part, substr(text, CAST(part * 40 + 1 AS BIGINT), 40) AS piece, round(t0 + (t1 - t0) / length(text) * part * 40, 6) AS p0, round(t0 + (t1 - t0) / length(text) * least(length(text), (part + 1) * 40), 6) AS p1 FROM p""",
)
def split_by_char(spark, d):
    return L.split_by_char(segments(spark, d), 40).select("conv_id", "turn", F.col("part").cast("long").alias("part"), "piece", R("p0").alias("p0"), R("p1").alias("p1"))


@query(
    "split_by_word",
    """WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM conversations),
f AS (SELECT conv_id, turn, l, 0 AS line, 1 AS k, l[1] AS cur FROM w WHERE len(l) > 0 UNION ALL
SELECT conv_id, turn, l, CASE WHEN length(cur) + 1 + length(l[k + 1]) <= 32 THEN line ELSE line + 1 END, k + 1, CASE WHEN length(cur) + 1 + length(l[k + 1]) <= 32 THEN cur || ' ' || l[k + 1] ELSE l[k + 1] END FROM f WHERE k < len(l))
SELECT conv_id, turn, CAST(line AS BIGINT) AS line, max_by(cur, k) AS piece FROM f GROUP BY conv_id, turn, line""",
)
def split_by_word(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(L.wrap_words(F.col("text"), 32)).alias("line", "piece"))
    return c.withColumn("line", F.col("line").cast("long"))


@query(
    "parallel_merge",
    f"""WITH {SEGMENTS}, c AS (SELECT conv_id, turn, length(text) * 0.05::DOUBLE AS n, role FROM segments), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lang FROM c)
SELECT conv_id, turn, round(before + 2.5, 6) AS t0, round(n + before + 2.5, 6) AS t1, lang FROM b""",
)
def parallel_merge(spark, d):
    n = F.length("text").cast("long") * 0.05
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lit(0.0).alias("t0"), n.alias("t1"), n.alias("n"), F.col("role").alias("lang"))
    m = L.shift(L.merge_chunks(c, ["conv_id"], "turn", "n", ["t0", "t1"], "lang"), ["t0", "t1"], 2.5)
    return m.select("conv_id", "turn", R("t0").alias("t0"), R("t1").alias("t1"), "lang")


@query("ring_buffer_last_n", f"WITH {SIGNAL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM signal) SELECT user_id, i, x, least(n, 16) - k AS slot FROM r WHERE k <= 16")
def ring_buffer_last_n(spark, d):
    return L.last_n(signal(spark, d), ["user_id"], ["i"], 16)


@query(
    "context_carry",
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations), p AS (SELECT a.conv_id, a.turn, coalesce(flatten(list(b.l ORDER BY b.turn) FILTER (b.turn IS NOT NULL)), []) AS past FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY a.conv_id, a.turn)
SELECT conv_id, turn, CAST(least(len(past), 24) AS INT) AS n, array_to_string(past[greatest(len(past) - 23, 1):], ' ') AS context FROM p""",
)
def context_carry(spark, d):
    c = L.carried(table(spark, d, "conversations"), ["conv_id"], "turn", F.split("text", " "), 24)
    return c.select("conv_id", "turn", F.size("context").alias("n"), F.array_join("context", " ").alias("context"))


@query(
    "median_filter7",
    f"""WITH {TENSOR}, o AS (SELECT vec_id, pos, pos + o AS j FROM tensor, (SELECT unnest(range(-3, 4)) AS o)), m AS (SELECT vec_id, pos, CASE WHEN j < 0 THEN -j WHEN j > 63 THEN 126 - j ELSE j END AS j FROM o)
SELECT m.vec_id, CAST(m.pos AS BIGINT) AS pos, round(median(t.v), 6) AS v FROM m JOIN tensor t ON t.vec_id = m.vec_id AND t.pos = m.j GROUP BY m.vec_id, m.pos""",
)
def median_filter7(spark, d):
    return L.reflect_median(tensor(spark, d), ["vec_id"], "v", 64).select("vec_id", F.col("pos").cast("long").alias("pos"), R("v").alias("v"))


@query("zscore_heads", f"WITH {TENSOR} SELECT vec_id, CAST(pos AS BIGINT) AS pos, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-9), 6) AS v FROM tensor WINDOW w AS (PARTITION BY label, pos)")
def zscore_heads(spark, d):
    return L.zscore(tensor(spark, d), ["label", "pos"], "v").select("vec_id", F.col("pos").cast("long").alias("pos"), R("v").alias("v"))


@query(
    "sliding_hop_window",
    "WITH h AS (SELECT event_id, value, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS s, unnest(range(0, 4)) AS k FROM events) SELECT (s - k) * 3600 AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY s - k",
)
def sliding_hop_window(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "4 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start_s"), "n", "total")


@query(
    "vad_session_window",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000) AS BIGINT) AS start_ms, count(*) AS n, round(max(value), 6) AS top FROM s GROUP BY user_id, k""",
)
def vad_session_window(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), R(F.max("value")).alias("top"))
    return s.select("user_id", F.unix_millis("w.start").alias("start_ms"), "n", "top")


@query("civil_date_parts", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, strftime(ts, '%H:%M') AS hm, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS days FROM events")
def civil_date_parts(spark, d):
    e = table(spark, d, "events")
    days = F.unix_date(F.to_date("ts"))
    day = F.date_from_unix_date(days)
    return e.select("event_id", F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), F.date_format("ts", "HH:mm").alias("hm"), days.alias("days"))




@query(
    "split_tokens",
    f"""WITH {SEGMENTS}, p AS (SELECT conv_id, turn, part, t0 + (t1 - t0) / length(text) * least(length(text), (part + 1) * 40) AS p1 FROM (SELECT *, unnest(range(0, (length(text) - 1) // 40 + 1)) AS part FROM segments WHERE length(text) > 0)),
w AS (SELECT conv_id, turn, t0, t1, k - 1 AS k, l[k] AS word FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM (SELECT conv_id, turn, t0, t1, string_split(text, ' ') AS l FROM segments))),
s AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn) AS t, coalesce(sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),
x AS (SELECT conv_id, turn, k, CASE WHEN t > 0 THEN t0 + (t1 - t0) * b / t ELSE t0 END AS w0 FROM s)
SELECT conv_id, turn, CAST(part AS BIGINT) AS part, count(*) AS n FROM (SELECT x.conv_id, x.turn, x.k, coalesce(min(part) FILTER (round(w0, 6) < round(p1, 6)), max(part)) AS part FROM x JOIN p USING (conv_id, turn) GROUP BY ALL) GROUP BY conv_id, turn, part""",
)
def split_tokens(spark, d):
    s = segments(spark, d)
    keys = ["conv_id", "turn"]
    words = s.select(*keys, "t0", "t1", F.posexplode(F.split("text", " ")).alias("k", "word"))
    words = L.token_times(words, keys, F.col("t0"), F.col("t1")).select(*keys, "k", R("w0").alias("w0"))
    parts = L.split_by_char(s, 40).withColumn("p1", R("p1"))
    return L.assign_parts(words, parts, keys).groupBy(*keys, F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


@query(
    "dtw_times",
    """WITH w AS (SELECT conv_id, turn, k, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS token, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS k FROM conversations)),
o AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id ORDER BY token) AS onset FROM w) SELECT conv_id, turn, CAST(k AS BIGINT) AS k, CASE WHEN n + 5 <= 448 AND conv_id % 7 <> 3 THEN round(CAST(onset AS DOUBLE) * 0.02::DOUBLE + conv_id, 6) END AS t_dtw FROM o""",
)
def dtw_times(spark, d):
    """Words as tokens whose onsets are the characters so far, over the segments of a conversation.

    Every seventh conversation has no matching head; those whose words, with four tokens before and one after them, are
    over 448 are skipped too.
    """
    from pyspark.sql import Window

    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "word"))
    w = Window.partitionBy("conv_id").orderBy("turn", "k")
    onsets = t.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("token"), F.sum(F.length("word")).over(w.rowsBetween(*L.UP_TO)).alias("onset")).where("conv_id % 7 <> 3")
    return L.onset_times(t, onsets, ["conv_id"], ["turn", "k"], F.col("conv_id"), context=448, before=4).select("conv_id", "turn", F.col("k").cast("long").alias("k"), F.round("t_dtw", 6).alias("t_dtw"))
