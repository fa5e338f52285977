"""Rows of scores: masks, softmax, ranking, beams, quality gates. Long form is (keys..., id, v), one row for each score.

A masked score is null, which aggregates skip, rather than minus infinity. Ties are broken by explicit keys everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def suppress_specials(id_: Column, v: Column, end: int, first_time: int) -> Column:
    """Ids above the end token and below the first time token are masked."""
    return F.when((id_ > end) & (id_ < first_time), F.lit(None)).otherwise(v)


def is_non_speech(text: Column) -> Column:
    """Not blank, and without a letter or digit."""
    return (F.trim(text) != "") & ~text.rlike(r"[\p{L}\p{N}]")


def grammar_penalty(scores: DataFrame, allowed: DataFrame, piece: str, penalty: float, exempt: Column) -> DataFrame:
    """`v` less the penalty where prefix + piece begins no candidate; `allowed` holds the prefixes of all candidates.

    The penalty is soft, and exempt rows (the end, times) and masked ones keep their score.
    """
    ok = scores.join(allowed.select(F.col("prefix").alias(piece)).distinct().withColumn("_ok", F.lit(True)), piece, "left")
    return ok.withColumn("v", F.when(F.col("_ok").isNull() & ~exempt, F.col("v") - penalty).otherwise(F.col("v"))).drop("_ok")


def prefixes(candidates: DataFrame, text: str) -> DataFrame:
    """All prefixes of all candidates, the empty one and the whole included, each once."""
    d = candidates.withColumn("n", F.explode(F.sequence(F.lit(0), F.length(text))))
    return d.select(F.expr(f"substring({text}, 1, n)").alias("prefix")).distinct()


def progress_of(said: DataFrame, text: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """`said` with consistent and complete: whether its text begins some candidate, and whether it is one. A null is neither."""
    whole = candidates.select(F.col(candidate).alias(text)).where(F.col(text).isNotNull()).distinct().withColumn("complete", F.lit(True))
    begun = prefixes(candidates, candidate).select(F.col("prefix").alias(text)).where(F.col(text).isNotNull()).withColumn("consistent", F.lit(True))
    d = said.join(begun, text, "left").join(whole, text, "left")
    return d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("consistent", "complete")})


def pairing(df: DataFrame, keys: list[str], order: str, is_time: str) -> DataFrame:
    """What the two tokens before each one forbid: times after two times, text after a time that closes text.

    Adds no_time and no_text, and least, the smallest time that may follow: the largest so far, or beyond it unless the
    last token is a time after text. A missing token counts as a time.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    last, before = F.lag(is_time, 1).over(w), F.lag(is_time, 2, True).over(w)
    d = df.withColumn("no_time", F.coalesce(last & before, F.lit(False))).withColumn("no_text", F.coalesce(last & ~before, F.lit(False)))
    largest = F.max(F.when(F.col(is_time), F.col("tok"))).over(w.rowsBetween(*BEFORE))
    return d.withColumn("least", largest + F.when(F.coalesce(last & ~before, F.lit(False)), 0).otherwise(1))


def log_softmax(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    w = Window.partitionBy(*keys)
    d = df.withColumn("_m", F.max(v).over(w))
    return d.withColumn(v, F.col(v) - F.col("_m") - F.ln(F.sum(F.exp(F.col(v) - F.col("_m"))).over(w))).drop("_m")


def softmax(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    w = Window.partitionBy(*keys)
    d = df.withColumn("_e", F.exp(F.col(v) - F.max(v).over(w)))
    return d.withColumn(v, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def times_outweigh_text(df: DataFrame, keys: list[str], is_time: Column) -> DataFrame:
    """For each row of scores: do all times together weigh more than the likeliest text?"""
    a = df.groupBy(*keys).agg(F.max(F.when(is_time, F.col("v"))).alias("_m"), F.max(F.when(~is_time, F.col("v"))).alias("text"))
    d = df.where(is_time).join(a, keys).groupBy(*keys).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col("v") - F.col("_m"))))).alias("time"), F.max("text").alias("text"))
    return d.withColumn("text_forbidden", F.col("time") > F.col("text"))


def top_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each row with rank, ties to the smaller id; Spark keeps k a key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.col("v").desc(), "id")
    return df.where("v is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax_last(df: DataFrame, keys: list[str]) -> DataFrame:
    """The best of each row, ties to the larger id."""
    return df.groupBy(*keys).agg(F.max(F.struct("v", "id")).alias("_b")).select(*keys, "_b.id", "_b.v")


def entropy(df: DataFrame, keys: list[str]) -> DataFrame:
    """In nats, of log-probabilities."""
    return df.groupBy(*keys).agg((-F.sum(F.exp("v") * F.col("v"))).alias("entropy"))


def sample(df: DataFrame, keys: list[str], temperature: float, r: Column) -> DataFrame:
    """The first id at which the running sum of softmax(v / temperature) reaches r, or the last id."""
    p = softmax(df.withColumn("v", F.col("v") / temperature), keys)
    w = Window.partitionBy(*keys).orderBy("id")
    p = p.withColumn("_c", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_c") >= r, F.col("id"))), F.max("id")).alias("id"))


def best_attempt(df: DataFrame, keys: list[str], score: str, attempt: str) -> DataFrame:
    """Of several attempts the one of best score, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), attempt)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fallback(df: DataFrame, keys: list[str], rung: str, passed: str) -> DataFrame:
    """The first rung of the ladder that passed, else the last one tried."""
    a = df.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(passed), F.col(rung))), F.max(rung)).alias(rung))
    return df.join(a, [*keys, rung])


def temperatures(start: float, step: float) -> list[float]:
    """start, start + step, ... up to 1; a step that is not positive gives start alone."""
    if step <= 0:
        return [start]
    n = int((1 + 1e-6 - start) / step + 1e-9)
    return [min(1.0, start + i * step) for i in range(n + 1)]


def passes(ratio: Column, logprob: Column, entropy: Column) -> Column:
    return (ratio < 2.4) & (logprob > -1.0) & (entropy > 2.4)


def is_silence(no_speech: Column, logprob: Column) -> Column:
    return (no_speech > 0.6) & (logprob < -1.0)


def beam_step(beams: DataFrame, scores: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One step of beam search: each beam's best `width` continuations, of which the best `width` of all stay.

    `beams` is (keys, beam, total), `scores` (keys, beam, id, v) in log-probabilities.
    """
    d = top_k(scores, [*keys, "beam"], width).drop("rank").join(beams, [*keys, "beam"]).withColumn("total", F.col("total") + F.col("v"))
    w = Window.partitionBy(*keys).orderBy(F.col("total").desc(), "beam", "id")
    return d.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= width)


def first_token(id_: Column, v: Column, first_time: int, last_initial: int) -> Column:
    """Before anything is sampled only times up to the last initial one keep their score."""
    return F.when((id_ >= first_time) & (id_ <= last_initial), v)


def suppress_blank(id_: Column, v: Column, blank: int, sampled: Column) -> Column:
    """Right after the first token the blank is masked."""
    return F.when((id_ == blank) & (sampled == 1), F.lit(None)).otherwise(v)


def final_hypothesis(df: DataFrame, keys: list[str], total: str, length: str, order: str) -> DataFrame:
    """The hypothesis of best mean log-probability, its end token counted; of equals the last in `order`."""
    w = Window.partitionBy(*keys).orderBy((F.col(total) / (F.col(length) + 1)).desc(), F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unconditioned(segments: DataFrame, keys: list[str], conditioned: str, text: str) -> DataFrame:
    """Segments of windows decoded with the context and without it: with it, unless that gave no text and without it is there."""
    w = Window.partitionBy(*keys)
    has_text = F.max(F.col(conditioned) & (F.coalesce(F.col(text), F.lit("")) != "")).over(w)
    retried = F.max(~F.col(conditioned)).over(w)
    return segments.withColumn("_keep", has_text | ~retried).where(F.col(conditioned) == F.col("_keep")).drop("_keep")


def stage_timings(runs: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, calls, total, longest, mean, share) of stage runs, the share being of all seconds."""
    s = runs.groupBy(stage).agg(F.count("*").alias("calls"), F.sum(seconds).alias("total"), F.max(seconds).alias("longest"))
    return s.withColumns({"mean": F.col("total") / F.col("calls"), "share": F.col("total") / F.sum("total").over(Window.partitionBy())})


def progress(df: DataFrame, keys: list[str], done: str, total: str, step: int) -> DataFrame:
    """(keys, percent, done): how much was done when a multiple of `step` per cent was first reached."""
    percent = F.floor(F.least(F.lit(100), F.floor(F.col(done) * 100 / F.col(total))) / step) * step
    return df.groupBy(*keys, percent.alias("percent")).agg(F.min(done).alias(done))
