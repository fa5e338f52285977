"""Log-mel spectra of long signals: frames are cut in Arrow tasks from blocks that overlap by a halo, and transformed there.

A block holds the samples of `FRAMES` frames and, as its halo, those its last frames share with the next block; so a sample
is sent to two blocks at most (if a block is longer than a frame), where one row for each sample and frame would be size / hop times as many. Blocks are dealt
by key and number, so a long signal is many tasks' work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import MEL_BREAK_HZ, MEL_LINEAR, MEL_STEP
from ..scratch import scratch
from .sequential import onsets
from .signal import HOP, MELS, N_FFT, RATE
from .timeline import reflect_median, zscore

#: Frames of a block.
FRAMES = 512


def filterbank(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    """The weights of signal.mel_filterbank as a matrix of n_mels rows."""
    knee = MEL_BREAK_HZ / MEL_LINEAR
    top = rate / 2 / MEL_LINEAR if rate / 2 < MEL_BREAK_HZ else knee + math.log(rate / 2 / MEL_BREAK_HZ) / MEL_STEP
    mel = top * np.arange(n_mels + 2) / (n_mels + 1)
    hz = np.where(mel < knee, mel * MEL_LINEAR, MEL_BREAK_HZ * np.exp(MEL_STEP * (mel - knee)))
    lo, mid, hi = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    k = np.arange(n_fft // 2 + 1)[None] * rate / n_fft
    return np.maximum(0.0, np.minimum((k - lo) / (mid - lo), (hi - k) / (hi - mid))) * 2 / (hi - lo)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power(frames: np.ndarray) -> np.ndarray:
    """The power of bins 0 to n / 2 of each row, by the fast transform (of mixed radix, so n need not be a power of two)."""
    z = np.fft.rfft(frames, axis=-1)
    return z.real**2 + z.imag**2


def mirrored(j: np.ndarray, n: int) -> np.ndarray:
    """The sample that stands at place j of a signal of n, mirrored at its ends; far beyond them the last one."""
    i = np.where(j < 0, -j, np.where(j >= n, 2 * (n - 1) - j, j))
    return np.where((i < 0) | (i > n - 1), n - 1, i)


def frames_of(x: np.ndarray, first: int, number: int, block: int, size: int, hop: int) -> np.ndarray:
    """The frames of block `number`; x are the samples from `first` on that it holds, up to the signal's end if that is near."""
    pad, top = size // 2, (number + 1) * block * hop + size // 2
    n = first + len(x)  # the signal's length if it ends in the block's reach, else more than the block needs
    last = min((number + 1) * block, n // hop if n < top else (number + 1) * block)
    t = np.arange(number * block, last)
    if not len(t):
        return np.zeros((0, size))
    j = np.arange(t[0] * hop - pad, t[-1] * hop + size - pad)
    whole = x[mirrored(j, n) - first]
    return np.lib.stride_tricks.sliding_window_view(whole, size)[::hop]


def log_mel_frames(samples: DataFrame, keys: list[str], *, n_fft: int = N_FFT, hop: int = HOP, n_mels: int = MELS, rate: int = RATE, block: int = FRAMES) -> DataFrame:
    """(keys, t, mel): for each of n div hop frames, centred at t * hop, the log10 of its mel energies, floored at 1e-10.

    `samples` are (keys, i, x), i from 0 without gaps; the ends are mirrored. A signal of under `hop` samples has no frame.
    """
    pad = n_fft // 2
    # a block reaches to its last frame's end and a hop beyond, to see whether the signal ends there
    at = lambda i: F.floor(i / (block * hop))
    d = samples.withColumn("_b", F.explode(F.sequence(F.greatest(at(F.col("i") - pad), F.lit(0)), at(F.col("i") + pad))))
    d = d.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("_s"))
    d = d.select(*keys, "_b", F.col("_s")[0]["i"].alias("_i"), F.col("_s.x").alias("_x"))
    schema = T.StructType([*[d.schema[k] for k in keys], *T.StructType.fromDDL("t long, mel array<double>")])
    names = schema.names

    def run(batches):
        bank, window = filterbank(n_mels, n_fft, rate).T, hann(n_fft)
        for b in batches:
            xs = b.column("_x")
            for r, (number, first) in enumerate(zip(b.column("_b").to_pylist(), b.column("_i").to_pylist(), strict=True)):
                x = xs[r].values.to_numpy(zero_copy_only=False)
                f = frames_of(x, first, number, block, n_fft, hop)
                if len(f):
                    mel = np.log10(np.maximum(power(f * window) @ bank, 1e-10))
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(mel) + 1, dtype=np.int32) * n_mels), pa.array(mel.ravel()))
                    own = [b.column(k).take(pa.array(np.full(len(mel), r))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(number * block + np.arange(len(mel))), rows], names=names)

    return d.mapInArrow(run, schema)


def log_mel(samples: DataFrame, keys: list[str], **options) -> DataFrame:
    """`log_mel_frames` clamped to 8 below each signal's top, and (x + 4) / 4.

    The frames are a table in the shared folder, as they are read twice: for the tops, a row a signal, and for the result.
    """
    frames = log_mel_frames(samples, keys, **options)
    path = f"{scratch(samples.sparkSession, 'mel')}/frames"
    frames.write.parquet(path)
    frames = samples.sparkSession.read.schema(frames.schema).parquet(path)
    tops = frames.groupBy(*keys).agg(F.max(F.array_max("mel")).alias("_top"))
    value = F.transform("mel", lambda v: (F.greatest(v, F.col("_top") - 8) + 4) / 4)
    return frames.join(tops, keys).select(*keys, "t", value.alias("mel"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def fft_power(x: pa.Array) -> pa.Array:
    """The power of bins 0 to n / 2 of arrays of numbers, by the fast transform; null for a null and for an empty array."""
    lens = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(lens)])
    bins = np.where(lens > 0, lens // 2 + 1, 0)
    at = np.concatenate([[0], np.cumsum(bins)])
    out = np.zeros(at[-1])
    for n in np.unique(lens[lens > 0]).tolist():
        own = np.flatnonzero(lens == n)
        p = power(flat[begin[own][:, None] + np.arange(n)])
        out[at[own][:, None] + np.arange(n // 2 + 1)] = p
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(lens == 0, False)), pa.array(out))


def heads_cost(weights: DataFrame, keys: list[str], n_time: int) -> DataFrame:
    """(keys, token, time, cost) of attention weights (keys, head, token, time, w): each head's weights normalized over its
    tokens at each time, smoothed along time by a median of 7 (fewer for short windows, always odd), averaged over heads and negated."""
    width = 7 if n_time > 7 else min(max((n_time - 1) | 1, 1), n_time)
    d = zscore(weights, [*keys, "head", "time"], "w").withColumnRenamed("time", "pos")
    d = reflect_median(d.select(*keys, "head", "token", "pos", "w"), [*keys, "head", "token"], "w", n_time, width)
    return d.groupBy(*keys, "token", F.col("pos").alias("time")).agg((-F.avg("w")).alias("cost"))


def token_onsets(weights: DataFrame, keys: list[str], n_time: int) -> DataFrame:
    """(keys, token, onset): when each token of a window begins, from the attention weights of its alignment heads."""
    return onsets(heads_cost(weights, keys, n_time), keys, "token", "time", "cost")
