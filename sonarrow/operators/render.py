"""Segments as documents: plain text, WebVTT, SRT, CSV, JSON, karaoke scripts, coloured console lines.

Each builds a line or block for a segment and joins them in order; a document is one string of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clock, csv_quote, drawtext_escape, json_escape, milliseconds, shell_quote, trimmed

FORMATS = ("txt", "vtt", "srt", "csv", "json", "json_full", "wts")


def _joined(df: DataFrame, keys: list[str], order: str, line: Column, between: str = "") -> DataFrame:
    """(keys, body): lines in order. A document's segments meet in one row, as its text does anywhere."""
    d = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s")))).alias("l"))
    return d.select(*keys, F.array_join(F.col("l.s"), between).alias("body"))


def txt(df, keys, order):
    return _joined(df, keys, order, F.concat(trimmed(F.col("text")), F.lit("\n")))


def vtt(df, keys, order):
    cue = F.concat(clock(F.col("t0")), F.lit(" --> "), clock(F.col("t1")), F.lit("\n"), trimmed(F.col("text")), F.lit("\n\n"))
    return _joined(df, keys, order, cue).withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))


def srt(df, keys, order, first: int = 0):
    """Cues are numbered from first + 1."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) + first
    cue = F.concat(F.col("_n").cast("string"), F.lit("\n"), clock(F.col("t0"), ","), F.lit(" --> "), clock(F.col("t1"), ","), F.lit("\n"), trimmed(F.col("text")), F.lit("\n\n"))
    return _joined(df.withColumn("_n", n), keys, order, cue)


def csv(df, keys, order):
    row = F.concat(milliseconds(F.col("t0")).cast("string"), F.lit(","), milliseconds(F.col("t1")).cast("string"), F.lit(","), csv_quote(trimmed(F.col("text"))), F.lit("\n"))
    return _joined(df, keys, order, row).withColumn("body", F.concat(F.lit("start,end,text\n"), "body"))


def _times() -> Column:
    stamps = F.concat(F.lit('      "timestamps": { "from": "'), clock(F.col("t0"), ","), F.lit('", "to": "'), clock(F.col("t1"), ","), F.lit('" },\n'))
    return F.concat(stamps, F.lit('      "offsets": { "from": '), milliseconds(F.col("t0")).cast("string"), F.lit(', "to": '), milliseconds(F.col("t1")).cast("string"), F.lit(" },\n"))


def _document(df, keys, order, segment, language):
    head = F.concat(F.lit('{\n  "language": "'), json_escape(F.lit(language)), F.lit('",\n  "transcription": [\n'))
    return _joined(df, keys, order, segment, ",\n").withColumn("body", F.concat(head, "body", F.lit("\n  ]\n}\n")))


def json(df, keys, order, language="en"):
    text = F.concat(F.lit('      "text": "'), json_escape(trimmed(F.col("text"))), F.lit('"\n'))
    return _document(df, keys, order, F.concat(F.lit("    {\n"), _times(), text, F.lit("    }")), language)


def json_full(df, keys, order, language="en"):
    """With tokens array<struct<id, text, prob, logprob, t0, t1, t_dtw>>; a null t_dtw is -1."""

    def token(t):
        number = lambda x: F.format_string("%.6f", x.cast("double"))
        stamps = F.concat(F.lit('          "timestamps": { "from": "'), clock(t["t0"], ","), F.lit('", "to": "'), clock(t["t1"], ","), F.lit('" },\n'))
        return F.concat(
            F.lit('        {\n          "id": '), t["id"].cast("string"), F.lit(',\n          "text": "'), json_escape(t["text"]), F.lit('",\n          "p": '), number(t["prob"]),
            F.lit(',\n          "plog": '), number(t["logprob"]), F.lit(",\n"), stamps, F.lit('          "t_dtw": '), number(F.coalesce(t["t_dtw"], F.lit(-1.0))), F.lit("\n        }"),
        )

    text = F.concat(F.lit('      "text": "'), json_escape(trimmed(F.col("text"))), F.lit('",\n      "tokens": [\n'))
    tokens = F.array_join(F.transform("tokens", token), ",\n")
    tokens = F.concat(tokens, F.when(F.size("tokens") > 0, "\n").otherwise(""), F.lit("      ]\n"))
    return _document(df, keys, order, F.concat(F.lit("    {\n"), _times(), text, tokens, F.lit("    }")), language)


def wts(df, keys, order, audio="in.wav", font="font.ttf"):
    """A shell script that burns every segment's text into a video as long as the last segment's end."""
    show = F.concat(
        F.lit("drawtext=fontfile="), shell_quote(F.lit(font)), F.lit(":fontsize=24:fontcolor=white:x=(w-text_w)/2:y=(h-text_h)/2:text='"), drawtext_escape(trimmed(F.col("text"))),
        F.format_string("':enable='between(t\\,%.3f\\,%.3f)'", "t0", "t1"),
    )
    end = df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("t1")).alias("_d"))
    d = _joined(df, keys, order, show, ",").join(end, keys)
    head = F.concat(F.format_string("#!/bin/bash\nffmpeg -y -f lavfi -i color=size=1200x120:duration=%.3f:rate=25:color=black \\\n  -i ", "_d"), shell_quote(F.lit(audio)), F.lit(' \\\n  -vf "'))
    return d.select(*keys, F.concat(head, "body", F.lit('" \\\n  -c:v libx264 -pix_fmt yuv420p -c:a aac -shortest out.mp4\n')).alias("body"))


def negotiated(df: DataFrame, keys: list[str], order: str, format_: str) -> DataFrame:
    """(keys, content_type, body) in the format each document asks for; unknown ones get JSON, verbose_json that of tokens."""
    kinds = {"text": (txt, "text/plain; charset=utf-8"), "srt": (srt, "application/x-subrip"), "vtt": (vtt, "text/vtt")}
    if "tokens" in df.columns:
        kinds["verbose_json"] = (json_full, "application/json")
    asked = F.when(F.col(format_).isin(*kinds), F.col(format_)).otherwise("json")
    d = df.withColumn("_f", asked)
    out = [f(d.where(F.col("_f") == k), keys, order).withColumn("content_type", F.lit(t)) for k, (f, t) in {**kinds, "json": (json, "application/json")}.items()]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.select(*keys, "content_type", "body")


def console(tokens: Column, colors: bool = True, confidence: bool = False) -> Column:
    """A line of tokens (text, prob), green from .8, yellow from .5, else red, or each with its probability in per cent."""

    def one(t):
        text = F.concat(F.trim(t["text"]), F.lit("("), F.format_string("%.0f", F.bround(t["prob"] * 100, 0)), F.lit("%)")) if confidence else t["text"]
        if not colors:
            return text
        tone = F.when(t["prob"] >= 0.8, "\x1b[32m").when(t["prob"] >= 0.5, "\x1b[33m").otherwise("\x1b[31m")
        return F.concat(tone, text, F.lit("\x1b[0m"))

    return F.array_join(F.transform(tokens, one), "")


def mean_logprob(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + t["logprob"]) / F.size(tokens)


def write(documents: DataFrame, path: str, key: str, format_: str) -> None:
    """Documents as text files under path, a folder for each key, written by the tasks that hold them."""
    body = F.regexp_replace("body", r"\n\z", "")  # the writer ends it
    documents.select(F.col(key).alias("key"), body.alias("value")).write.partitionBy("key").mode("overwrite").text(f"{path}/{format_}")


def write_all(df: DataFrame, keys: list[str], order: str, path: str, formats=FORMATS) -> None:
    """Every format asked for from one cached pass over the segments; json_full takes the place of json."""
    made = {"txt": txt, "vtt": vtt, "srt": srt, "csv": csv, "json": json, "json_full": json_full, "wts": wts}
    kept = df.cache()
    try:
        for f in formats:
            if not (f == "json" and "json_full" in formats):
                write(made[f](kept, keys, order), path, keys[0], f)
    finally:
        kept.unpersist()
