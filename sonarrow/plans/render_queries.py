"""Documents rendered from segments, one for each conversation, and from activity segments of the event signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import render as K
from ..tables import table
from .catalog import query
from .timeline_queries import ISLANDS, padded
from .views import SEGMENTS, segments

MS = lambda t: f"CAST(round({t} * 1000) AS BIGINT)"


def _clock(t, point="."):
    ms = MS(t)
    return f"printf('%02d:%02d:%02d{point}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


TRIM = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"
NL = "chr(10)"
JSON = "replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
VTT = f"'WEBVTT' || {NL} || {NL} || string_agg({_clock('t0')} || ' --> ' || {_clock('t1')} || {NL} || {TRIM} || {NL} || {NL}, '' ORDER BY turn)"
SRT = f"string_agg(n || {NL} || {_clock('t0', ',')} || ' --> ' || {_clock('t1', ',')} || {NL} || {TRIM} || {NL} || {NL}, '' ORDER BY turn)"
TXT = f"string_agg({TRIM} || {NL}, '' ORDER BY turn)"
TIMES = f"""'      "timestamps": {{ "from": "' || {_clock('t0', ',')} || '", "to": "' || {_clock('t1', ',')} || '" }},' || {NL} || '      "offsets": {{ "from": ' || {MS('t0')} || ', "to": ' || {MS('t1')} || ' }},' || {NL}"""
JSON_DOC = f"""'{{' || {NL} || '  "language": "en",' || {NL} || '  "transcription": [' || {NL} || string_agg('    {{' || {NL} || {TIMES} || '      "text": "' || {JSON.format(TRIM)} || '"' || {NL} || '    }}', ',' || {NL} ORDER BY turn) || {NL} || '  ]' || {NL} || '}}' || {NL}"""
NUMBERED = f"{SEGMENTS}, num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM segments)"
FULL = ["conv_id"]


@query("render_txt", f"WITH {SEGMENTS} SELECT conv_id, {TXT} AS body FROM segments GROUP BY conv_id")
def render_txt(spark, d):
    return K.txt(segments(spark, d), FULL, "turn")


@query("render_vtt", f"WITH {SEGMENTS} SELECT conv_id, {VTT} AS body FROM segments GROUP BY conv_id")
def render_vtt(spark, d):
    return K.vtt(segments(spark, d), FULL, "turn")


@query("render_srt", f"WITH {NUMBERED} SELECT conv_id, {SRT} AS body FROM num GROUP BY conv_id")
def render_srt(spark, d):
    return K.srt(segments(spark, d), FULL, "turn")


@query("render_csv", f"WITH {SEGMENTS} SELECT conv_id, 'start,end,text' || {NL} || string_agg({MS('t0')} || ',' || {MS('t1')} || ',\"' || replace({TRIM}, '\"', '\"\"') || '\"' || {NL}, '' ORDER BY turn) AS body FROM segments GROUP BY conv_id")
def render_csv(spark, d):
    return K.csv(segments(spark, d), FULL, "turn")


@query("render_json", f"WITH {SEGMENTS} SELECT conv_id, {JSON_DOC} AS body FROM segments GROUP BY conv_id")
def render_json(spark, d):
    return K.json(segments(spark, d), FULL, "turn")


def _with_tokens(spark, d):
    """A segment's words as tokens, with probabilities from their lengths."""
    words = F.split("text", " ")
    p = lambda w: (F.length(w) % 10 + 1) / 11.0
    token = lambda w, i: F.struct(i.alias("id"), F.concat(F.lit(" "), w).alias("text"), p(w).alias("prob"), F.round(F.ln(p(w)), 4).alias("logprob"), (F.col("t0") + i * 0.25).alias("t0"), (F.col("t0") + i * 0.25 + 0.25).alias("t1"), F.when(i == 1, F.col("t0") + 0.02).alias("t_dtw"))
    return segments(spark, d).withColumn("tokens", F.transform(words, token))


TOK = f"{SEGMENTS}, w AS (SELECT *, string_split(text, ' ') AS l FROM segments), tk AS (SELECT conv_id, turn, t0 AS s0, i - 1 AS id, l[i] AS word, (length(l[i]) % 10 + 1) / 11.0::DOUBLE AS p FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM w)), tt AS (SELECT *, s0 + id * 0.25::DOUBLE AS t0, s0 + id * 0.25::DOUBLE + 0.25::DOUBLE AS t1, round(ln(p), 4) AS plog FROM tk)"
TOKEN_DOC = f"""'        {{' || {NL} || '          "id": ' || id || ',' || {NL} || '          "text": "' || {JSON.format("' ' || word")} || '",' || {NL} || '          "p": ' || printf('%.6f', p) || ',' || {NL} || '          "plog": ' || printf('%.6f', plog) || ',' || {NL} || '          "timestamps": {{ "from": "' || {_clock('t0', ',')} || '", "to": "' || {_clock('t1', ',')} || '" }},' || {NL} || '          "t_dtw": ' || printf('%.6f', CASE WHEN id = 1 THEN s0 + 0.02::DOUBLE ELSE -1.0::DOUBLE END) || {NL} || '        }}'"""
JSON_FULL_DOC = JSON_DOC.replace("""|| '"' || chr(10) || '    }'""", """|| '",' || chr(10) || '      "tokens": [' || chr(10) || toks || chr(10) || '      ]' || chr(10) || '    }'""")


@query("render_json_full", f"WITH {TOK}, td AS (SELECT conv_id, turn, string_agg({TOKEN_DOC}, ',' || {NL} ORDER BY id) AS toks FROM tt GROUP BY conv_id, turn) SELECT conv_id, {JSON_FULL_DOC} AS body FROM segments JOIN td USING (conv_id, turn) GROUP BY conv_id")
def render_json_full(spark, d):
    return K.json_full(_with_tokens(spark, d), FULL, "turn")


@query(
    "render_wts",
    f"""WITH {SEGMENTS} SELECT conv_id, '#!/bin/bash' || {NL} || 'ffmpeg -y -f lavfi -i color=size=1200x120:duration=' || printf('%.3f', greatest(0.0, max(t1))) || ':rate=25:color=black ' || chr(92) || {NL} || '  -i ''in.wav'' ' || chr(92) || {NL} || '  -vf "' ||
string_agg('drawtext=fontfile=''font.ttf'':fontsize=24:fontcolor=white:x=(w-text_w)/2:y=(h-text_h)/2:text=''' || replace(replace(replace({TRIM}, chr(92), chr(92) || chr(92)), '''', chr(92) || ''''), ':', chr(92) || ':') || ''':enable=''between(t' || chr(92) || ',' || printf('%.3f', t0) || chr(92) || ',' || printf('%.3f', t1) || ')''', ',' ORDER BY turn) ||
'" ' || chr(92) || {NL} || '  -c:v libx264 -pix_fmt yuv420p -c:a aac -shortest out.mp4' || {NL} AS body FROM segments GROUP BY conv_id""",
)
def render_wts(spark, d):
    return K.wts(segments(spark, d), FULL, "turn")


@query(
    "render_negotiated",
    f"""WITH {TOK}, num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM segments), td AS (SELECT conv_id, turn, string_agg({TOKEN_DOC}, ',' || {NL} ORDER BY id) AS toks FROM tt GROUP BY conv_id, turn)
SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'text/plain; charset=utf-8' WHEN 1 THEN 'application/x-subrip' WHEN 2 THEN 'text/vtt' ELSE 'application/json' END AS content_type, CASE conv_id % 5 WHEN 0 THEN {TXT} WHEN 1 THEN {SRT} WHEN 2 THEN {VTT} WHEN 3 THEN {JSON_FULL_DOC} ELSE {JSON_DOC} END AS body FROM num JOIN td USING (conv_id, turn) GROUP BY conv_id""",
)
def render_negotiated(spark, d):
    asked = F.element_at(F.array(*[F.lit(x) for x in ("text", "srt", "vtt", "verbose_json", "pdf")]), (F.col("conv_id") % 5 + 1).cast("int"))
    return K.negotiated(_with_tokens(spark, d).withColumn("format", asked), FULL, "turn", "format")


@query(
    "confidence_render",
    f"WITH {TOK} SELECT conv_id, turn, string_agg(CASE WHEN p >= 0.8 THEN chr(27) || '[32m' WHEN p >= 0.5 THEN chr(27) || '[33m' ELSE chr(27) || '[31m' END || ' ' || word || chr(27) || '[0m', '' ORDER BY id) AS line, string_agg(trim(' ' || word) || '(' || CAST(round_even(p * 100, 0) AS INT) || '%)', '' ORDER BY id) AS shares FROM tt GROUP BY conv_id, turn",
)
def confidence_render(spark, d):
    return _with_tokens(spark, d).select("conv_id", "turn", K.console(F.col("tokens")).alias("line"), K.console(F.col("tokens"), False, True).alias("shares"))


@query("avg_score", f"WITH {TOK} SELECT conv_id, turn, round(avg(plog), 6) AS score FROM tt GROUP BY conv_id, turn")
def avg_score(spark, d):
    return _with_tokens(spark, d).select("conv_id", "turn", F.round(K.mean_logprob(F.col("tokens")), 6).alias("score"))


@query("escapes", f"SELECT page_id, {JSON.format('url')} AS j, '''' || replace(url, '''', '''' || chr(92) || '''''') || '''' AS s FROM pages")
def escapes(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.json_escape(u).alias("j"), S.shell_quote(u).alias("s"))


@query(
    "render_vad_srt",
    f"WITH {ISLANDS}, c AS (SELECT user_id, k AS turn, s * 0.5::DOUBLE AS t0, e * 0.5::DOUBLE AS t1, 'speech ' || k AS text, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM padded) SELECT user_id, {SRT} AS body FROM c GROUP BY user_id",
)
def render_vad_srt(spark, d):
    """Scan, hysteresis, padding and subtitles: the reference's whole path from samples to a document."""
    p = padded(spark, d).select("user_id", F.col("k").alias("turn"), (F.col("start") * 0.5).alias("t0"), (F.col("end") * 0.5).alias("t1"), F.concat(F.lit("speech "), F.col("k").cast("string")).alias("text"))
    return K.srt(p, ["user_id"], "turn")
