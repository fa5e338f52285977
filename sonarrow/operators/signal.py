"""Sampled signals. Long form is (key..., i, x), i the index from 0; array form is one array column for each row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hann, hz_to_mel, mel_to_hz

RATE, N_FFT, HOP, MELS = 16000, 400, 160, 80


def downmix(df: DataFrame, keys: list[str], frame: str, x: str) -> DataFrame:
    """The mean over a frame's channels; a last frame with fewer channels is averaged over those it has."""
    return df.groupBy(*keys, frame).agg(F.avg(x).alias("x"))


def resample_linear(df: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Linear interpolation to another rate: round(n * target / source) samples, the last sample standing for what is beyond.

    Each sample is sent to the outputs between it and its successor, so that nothing but the keys' windows is joined.
    """
    w = Window.partitionBy(*keys)
    d = df.withColumn("n", F.count("*").over(w)).withColumn("next", F.coalesce(F.lead("x").over(w.orderBy("i")), F.col("x")))
    out = F.round(F.col("n") * target / source).cast("long")
    # outputs j with floor(j * source / target) = i; the last sample also serves all later ones
    first = F.ceil(F.col("i") * target / source)
    last = F.when(F.col("i") == F.col("n") - 1, out - 1).otherwise(F.least(F.ceil((F.col("i") + 1) * target / source) - 1, out - 1))
    d = d.withColumn("j", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("j") * source / target
    return d.select(*keys, F.col("j").alias("i"), (F.col("x") + (F.col("next") - F.col("x")) * (at - F.floor(at))).alias("x"))


def pad_or_trim(x: Column, n: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size(x)))
    return F.concat(F.slice(x, 1, n), zeros)


def reflect_pad(x: Column, pad: int) -> Column:
    """`pad` values mirrored at either end, the end value itself not repeated."""
    n = F.size(x)
    head = F.transform(F.sequence(F.lit(0), F.lit(pad - 1)), lambda j: F.element_at(x, (pad - j + 1).cast("int")))
    tail = F.transform(F.sequence(F.lit(0), F.lit(pad - 1)), lambda j: F.element_at(x, (n - 1 - j).cast("int")))
    return F.concat(head, x, tail)


def frames(df: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """(keys, t, k, x): overlapping frames t of `size` samples, n div hop of them; samples beyond the end are left out.

    A sample is sent to the frames it lies in, at most ceil(size / hop), in place of a range join.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    d = df.withColumn("last", F.least(F.floor(F.col("i") / hop), F.floor(n / hop) - 1)).withColumn("first", F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / hop)))
    d = d.where("first <= last").withColumn("t", F.explode(F.sequence("first", "last")))
    return d.select(*keys, "t", (F.col("i") - F.col("t") * hop).alias("k"), "x")


def dft_power(x: Column, n: int) -> Column:
    """The power of bins 0 to n / 2 of an array of n values, by the definition; no row is multiplied."""

    def bin_(k):
        part = lambda f: F.aggregate(F.transform(x, lambda v, i: v * f(2 * math.pi * k * i / n)), F.lit(0.0), lambda a, b: a + b)
        re, im = part(F.cos), part(F.sin)
        return re * re + im * im

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), bin_)


def mel_filterbank(spark, n_mels: int, n_fft: int, rate: int) -> DataFrame:
    """(m, k, w): triangular filters, even in mels from 0 to half the rate, each of equal area; n_mels * (n_fft / 2 + 1) rows."""
    top = hz_to_mel(F.lit(rate / 2.0))
    edge = lambda j: mel_to_hz(top * j / (n_mels + 1))
    m = spark.range(n_mels).select(F.col("id").alias("m")).select("m", edge(F.col("m")).alias("lo"), edge(F.col("m") + 1).alias("mid"), edge(F.col("m") + 2).alias("hi"))
    d = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2)))).withColumn("hz", F.col("k") * (rate / n_fft))
    rise, fall = (F.col("hz") - F.col("lo")) / (F.col("mid") - F.col("lo")), (F.col("hi") - F.col("hz")) / (F.col("hi") - F.col("mid"))
    return d.select("m", "k", (F.greatest(F.lit(0.0), F.least(rise, fall)) * 2 / (F.col("hi") - F.col("lo"))).alias("w"))


def log_mel(power: DataFrame, filters: DataFrame, keys: list[str], window: list[str]) -> DataFrame:
    """(keys, m, v) of power spectra (keys, k, p): projection, log10 with a floor, clamp to 8 below the window's top, (x + 4) / 4.

    The filter bank has a fixed size and is broadcast; the projection aggregates by frame.
    """
    mel = power.join(F.broadcast(filters.where("w > 0")), "k").groupBy(*keys, "m").agg(F.sum(F.col("w") * F.col("p")).alias("e"))
    mel = mel.withColumn("l", F.log10(F.greatest("e", F.lit(1e-10))))
    floor = F.max("l").over(Window.partitionBy(*window)) - 8
    return mel.select(*keys, "m", ((F.greatest("l", floor) + 4) / 4).alias("v"))


def high_pass(x: Column, cutoff: float, rate: float) -> Column:
    """The in-place one-pole form, which leaves the first sample and scales the others by dt / (rc + dt)."""
    dt, rc = 1 / rate, 1 / (2 * math.pi * cutoff)
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v * (dt / (rc + dt))))


def high_pass_at(i: Column, x: Column, cutoff: float, rate: float) -> Column:
    """The same for a sample x at place i, as its factor depends on nothing else."""
    dt, rc = 1 / rate, 1 / (2 * math.pi * cutoff)
    return F.when(i == 0, x).otherwise(x * (dt / (rc + dt)))


def quiet_tail(df: DataFrame, keys: list[str], last: int, threshold: float) -> DataFrame:
    """Is the mean amplitude of the last `last` samples at most `threshold` times that of all? Not if there are no others."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("tail", F.row_number().over(w.orderBy(F.col("i").desc())) <= last)
    a = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs("x")).alias("all_energy"), F.avg(F.when(F.col("tail"), F.abs("x"))).alias("tail_energy"))
    return a.withColumn("quiet", (F.col("n") > last) & (F.col("tail_energy") <= threshold * F.col("all_energy")))


def louder_channel(samples: DataFrame, spans: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """For spans (keys, seg, a, b) of sample indices the channel of larger RMS in [a, b) of samples (keys, i, left, right).

    Ties go to channel 0; an empty span has none. Spans and samples meet by index bucket, not by a range join.
    """
    s = spans.withColumn("bucket", F.explode(F.when(F.col("b") > F.col("a"), F.sequence(F.floor(F.col("a") / bucket), F.floor((F.col("b") - 1) / bucket)))))
    d = samples.withColumn("bucket", F.floor(F.col("i") / bucket)).join(s, [*keys, "bucket"]).where("i >= a and i < b")
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    e = d.groupBy(*keys, "seg").agg(rms("left").alias("left"), rms("right").alias("right"))
    return spans.join(e, [*keys, "seg"], "left").select(*spans.columns, F.when(F.col("left").isNotNull(), F.when(F.col("right") > F.col("left"), 1).otherwise(0)).alias("speaker"))


def crop(df: DataFrame, offset: int, length: int | None) -> DataFrame:
    d = df.where(F.col("i") >= offset)
    return d if length is None else d.where(F.col("i") < offset + length)


def windowed(df: DataFrame, n: int) -> DataFrame:
    """Frames with the Hann window applied."""
    return df.withColumn("x", F.col("x") * hann(F.col("k"), n))
