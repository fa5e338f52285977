"""Segments on a time line: islands of activity, padding, cropping and its time map, token streams, splits and merges.

All windows are keyed, by stream or by window; what has to be in order within a key is ordered by an explicit index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def hysteresis(df: DataFrame, keys: list[str], p: str, threshold: float = 0.5) -> DataFrame:
    """(keys, k, start, end): islands that open where p reaches the threshold and end where it falls under the lower one.

    The state is the last decision seen, as values between the thresholds decide nothing. `end` is exclusive, k from 1.
    """
    low = max(threshold - 0.15, 0.01)
    w = Window.partitionBy(*keys).orderBy("i")
    on = F.coalesce(F.last(F.when(F.col(p) >= threshold, 1).when(F.col(p) < low, 0), ignorenulls=True).over(w.rowsBetween(*UP_TO)), F.lit(0))
    d = df.withColumn("on", on).withColumn("opens", (F.col("on") == 1) & (F.coalesce(F.lag("on").over(w), F.lit(0)) == 0))
    d = d.withColumn("k", F.sum(F.col("opens").cast("long")).over(w.rowsBetween(*UP_TO))).where("on = 1")
    return d.groupBy(*keys, "k").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))


def pad(df: DataFrame, keys: list[str], by: int, length: Column) -> DataFrame:
    """Spans (keys, k, start, end) grown by `by` at either end, within [0, length); a gap of under twice that is halved.

    Both sides of a gap read it before either moves, so an odd gap leaves one sample between them.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    before, after = F.col("start") - F.lag("end").over(w), F.lead("start").over(w) - F.col("end")
    left = F.when(before.isNull(), F.greatest(F.lit(0), F.col("start") - by)).when(before < 2 * by, F.col("start") - F.floor(before / 2)).otherwise(F.col("start") - by)
    right = F.when(after.isNull(), F.least(length, F.col("end") + by)).when(after < 2 * by, F.col("end") + F.floor(after / 2)).otherwise(F.col("end") + by)
    return df.withColumns({"start": left.cast("long"), "end": right.cast("long")})


def crop_map(df: DataFrame, keys: list[str], gap: int, overlap: int, length: Column) -> DataFrame:
    """Where each span (keys, k, start, end) lies once spans are cut out and put together with `gap` samples between.

    Adds cut_end (with the overlap, clamped) and processed, the first sample's new index. Empty spans take no place.
    """
    d = df.withColumn("cut_end", F.least(F.col("end") + overlap, length)).where("cut_end > start")
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(*BEFORE)
    return d.withColumn("processed", F.coalesce(F.sum(F.col("cut_end") - F.col("start") + gap).over(w), F.lit(0)).cast("long"))


def original_time(points: DataFrame, anchors: DataFrame, keys: list[str], t: str) -> DataFrame:
    """`points` with original: t moved by the last anchor (keys, processed, original) at or before it, else by the first.

    The as-of join is one sort: anchors and points of a key are laid in order and the last anchor is carried on. Without
    anchors times stay as they are.
    """
    first = anchors.groupBy(*keys).agg(F.min_by("processed", "processed").alias("p0"), F.min_by("original", "processed").alias("o0"))
    a = anchors.select(*keys, F.col("processed").alias("at"), F.lit(0).alias("is_point"), F.struct("processed", "original").alias("anchor"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("row"))
    p = points.select(*keys, F.col(t).alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast(a.schema["anchor"].dataType).alias("anchor"), F.struct("*").alias("row"))
    w = Window.partitionBy(*keys).orderBy("at", "is_point").rowsBetween(*UP_TO)
    d = a.unionByName(p).withColumn("last", F.last("anchor", ignorenulls=True).over(w)).where("is_point = 1").select("row.*", "last").join(first, keys, "left")
    base = F.coalesce("last.processed", "p0", F.lit(0)), F.coalesce("last.original", "o0", F.lit(0))
    return d.withColumn("original", base[1] + F.col(t) - base[0]).drop("last", "p0", "o0")


def parse_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_i, end_i, n_text): the segments of a token stream (keys, i, is_ts).

    A time token opens a segment, the next one closes it, text outside is dropped, and a time token after none opens anew.
    In closed form: of the runs from one time token to the next, ranked among those with text between two runs without,
    the odd ones are segments; the end is the next run's start and null at the end of the stream.
    """
    w = Window.partitionBy(*keys)
    runs = df.withColumn("run", F.sum(F.col("is_ts").cast("long")).over(w.orderBy("i").rowsBetween(*UP_TO))).where("run > 0")
    runs = runs.groupBy(*keys, "run").agg(F.min("i").alias("start_i"), F.sum((~F.col("is_ts")).cast("long")).alias("n_text"))
    runs = runs.withColumn("end_i", F.lead("start_i").over(w.orderBy("run")))
    runs = runs.withColumn("stretch", F.coalesce(F.sum((F.col("n_text") == 0).cast("long")).over(w.orderBy("run").rowsBetween(*BEFORE)), F.lit(0))).where("n_text > 0")
    rank = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("run"))
    return runs.withColumn("rank", rank).where("rank % 2 = 1").select(*keys, "start_i", "end_i", "n_text")


def token_times(df: DataFrame, keys: list[str], t0: Column, t1: Column) -> DataFrame:
    """Words (keys, k, word) with times in proportion to characters between t0 and t1; without any, the whole span."""
    w = Window.partitionBy(*keys)
    n = F.length("word")
    total = F.sum(n).over(w)
    before = F.coalesce(F.sum(n).over(w.orderBy("k").rowsBetween(*BEFORE)), F.lit(0))
    share = lambda x: F.when(total > 0, t0 + (t1 - t0) * x / total)
    return df.withColumns({"w0": F.coalesce(share(before), t0), "w1": F.coalesce(share(before + n), t1)})


def split_by_char(df: DataFrame, most: int) -> DataFrame:
    """Segments (t0, t1, text, ...) cut into pieces of `most` characters (part, piece), times in proportion."""
    n = F.length("text")
    d = df.where(n > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / most))))
    span = (F.col("t1") - F.col("t0")) / n
    return d.withColumns(
        {
            "piece": F.substring(F.col("text"), F.col("part").cast("int") * most + 1, F.lit(most)),
            "p0": F.col("t0") + span * F.col("part") * most,
            "p1": F.col("t0") + span * F.least(n, (F.col("part") + 1) * most),
        }
    )


def wrap_words(text: Column, most: int) -> Column:
    """Lines of whole words of at most `most` characters; a longer word is a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))

    def add(acc, word):
        fits = acc["line"].isNotNull() & (F.length(acc["line"]) + 1 + F.length(word) <= most)
        lines = F.when(fits | acc["line"].isNull(), acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"]))
        return F.struct(lines.alias("lines"), F.when(fits, F.concat(acc["line"], F.lit(" "), word)).otherwise(word).alias("line"))

    return F.aggregate(words, start, add, lambda acc: F.when(acc["line"].isNull(), acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])))


def merge_chunks(df: DataFrame, keys: list[str], chunk: str, length: str, times: list[str], language: str) -> DataFrame:
    """Times of chunks decoded apart, moved by the lengths of the chunks before; the first chunk's language holds for all."""
    lengths = df.groupBy(*keys, chunk).agg(F.max(length).alias("_n"), F.min(language).alias("_l"))
    w = Window.partitionBy(*keys).orderBy(chunk)
    lengths = lengths.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(*BEFORE)), F.lit(0.0)))
    lengths = lengths.withColumn("_language", F.first("_l").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = df.join(lengths.drop("_n", "_l"), [*keys, chunk])
    return d.withColumns({t: F.col(t) + F.col("_before") for t in times} | {language: F.col("_language")}).drop("_before", "_language")


def shift(df: DataFrame, times: list[str], by: float) -> DataFrame:
    return df.withColumns({t: F.col(t) + by for t in times})


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """What a ring buffer of n holds at the end, oldest first as slot 0; Spark keeps n rows a key and task before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    d = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return d.withColumn("slot", F.count("*").over(Window.partitionBy(*keys)) - F.col("_r")).drop("_r")


def carried(df: DataFrame, keys: list[str], order: str, words: Column, most: int) -> DataFrame:
    """The last `most` words of what came before each row of a key.

    A frame goes back over rows only until it has so many words: it is a range of the number of words before each row, over
    the words of the row before it. Rows of a key differ in `order`. A null list has no words.
    """
    by = Window.partitionBy(*keys)
    d = df.withColumn("_w", F.coalesce(words, F.array().cast("array<string>")))
    d = d.withColumns({"_last": F.lag("_w").over(by.orderBy(order)), "_before": F.coalesce(F.sum(F.size("_w")).over(by.orderBy(order).rowsBetween(*BEFORE)), F.lit(0)).cast("long")})
    # rows with as many words before them as this one come later and add none, as all between are empty
    past = F.flatten(F.collect_list("_last").over(by.orderBy("_before").rangeBetween(-(most - 1), 0)))
    return d.withColumn("context", F.slice(past, F.greatest(F.size(past) - most + 1, F.lit(1)), F.lit(most))).drop("_w", "_last", "_before")


def reflect_median(df: DataFrame, keys: list[str], value: str, n: int, width: int = 7) -> DataFrame:
    """The median over `width` places of series (keys, pos, value) of n values, mirrored at the ends."""
    half = width // 2
    spread = df.withColumn("o", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    # a value at pos serves its neighbours, and by reflection those whose mirrored window reaches it
    targets = F.array_distinct(F.array(F.col("pos") + F.col("o"), F.when((F.col("pos") > 0) & (F.col("pos") <= half), -F.col("pos") + F.col("o")), F.when((F.col("pos") < n - 1) & (F.col("pos") >= n - 1 - half), 2 * (n - 1) - F.col("pos") + F.col("o"))))
    d = spread.withColumn("t", F.explode(F.filter(targets, lambda x: x.isNotNull() & (x >= 0) & (x < n))))
    return d.groupBy(*keys, F.col("t").alias("pos")).agg(F.sort_array(F.collect_list(value)).alias("s")).select(*keys, "pos", F.element_at("s", half + 1).alias(value))


def zscore(df: DataFrame, by: list[str], value: str, eps: float = 1e-9) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + eps))


def assign_parts(tokens: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """`tokens` (keys, k, w0, ...) with the part of their split segment: the first that ends after they begin, or the last.

    A segment's parts are bounded by its length, and both sides meet on the segment's keys.
    """
    j = tokens.join(parts.select(*keys, "part", "p1"), keys)
    fits = F.min(F.when(F.col("w0") < F.col("p1"), F.col("part")))
    return j.groupBy(*tokens.columns).agg(F.coalesce(fits, F.max("part")).alias("part"))


def onset_times(tokens: DataFrame, onsets: DataFrame, keys: list[str], order: list[str], offset: Column, *, context: int, before: int, step: float = 0.02) -> DataFrame:
    """`tokens` with t_dtw: the onset (keys, token, onset) of each token of a window, counted over its segments, in seconds.

    A window is skipped as a whole, so that none of its tokens has a time, if its tokens with the `before` ones ahead of
    them and the end token are more than `context`, or if it has no onsets (no alignment head matches).
    """
    w = Window.partitionBy(*keys)
    d = tokens.withColumns({"token": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "_n": F.count("*").over(w)})
    d = d.join(onsets.select(*keys, "token", "onset"), [*keys, "token"], "left")
    return d.withColumn("t_dtw", F.when(F.col("_n") + before + 1 <= context, F.col("onset") * step + offset)).drop("token", "onset", "_n")
