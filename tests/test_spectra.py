"""Spectra of long signals and the alignment of heads against numpy and the definitions."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarrow.operators import signal, spectra


def dft_power(x):
    n = len(x)
    out = []
    for k in range(n // 2 + 1):
        re = sum(v * math.cos(2 * math.pi * k * i / n) for i, v in enumerate(x))
        im = sum(v * math.sin(2 * math.pi * k * i / n) for i, v in enumerate(x))
        out.append(re * re + im * im)
    return out


def test_fft_power(spark):
    """All lengths, and 400 as the front end has it, against the definition and the built-in form."""
    x400 = [(i * 7 + 3) % 13 / 13 - 0.5 for i in range(400)]
    rows = [[0.5], [1.0, -2.0], [0.1 * i for i in range(7)], x400, None, [], [float(i % 5) for i in range(64)], x400[::-1]]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>").coalesce(1)
    got = {r.i: r.p for r in d.select("i", spectra.fft_power("x").alias("p")).collect()}
    for i, x in enumerate(rows):
        assert got[i] == (pytest.approx(dft_power(x), abs=1e-8) if x else None)
    (b,) = spark.createDataFrame([(x400,)], "x array<double>").select(signal.dft_power(F.col("x"), 400).alias("p")).collect()
    assert got[3] == pytest.approx(b.p, abs=1e-6)


def test_filterbank(spark):
    want = np.zeros((80, 201))
    for r in signal.mel_filterbank(spark, 80, 400, 16000).collect():
        want[r.m, r.k] = r.w
    np.testing.assert_allclose(spectra.filterbank(80, 400, 16000), want, atol=1e-12)


def log_mel(x, n_fft, hop, n_mels, rate):
    """The chain for one whole signal."""
    n, pad = len(x), n_fft // 2
    place = lambda j: n - 1 if not 0 <= (i := -j if j < 0 else 2 * (n - 1) - j if j >= n else j) < n else i
    padded = np.array([x[place(j - pad)] for j in range(n + 2 * pad)]) if n else np.zeros(0)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    bank = spectra.filterbank(n_mels, n_fft, rate)
    rows = [np.log10(np.maximum(bank @ np.abs(np.fft.fft(padded[t * hop : t * hop + n_fft] * window)[: n_fft // 2 + 1]) ** 2, 1e-10)) for t in range(n // hop)]
    top = max((r.max() for r in rows), default=0)
    return [(np.maximum(r, top - 8) + 4) / 4 for r in rows]


@pytest.mark.parametrize("options", [{"n_fft": 400, "hop": 160, "n_mels": 80, "block": 4}, {"n_fft": 20, "hop": 8, "n_mels": 6, "block": 1}, {"n_fft": 12, "hop": 9, "n_mels": 3, "block": 2}])
def test_log_mel(spark, options):
    """Signals of all lengths about the edges of blocks and frames; frames do not depend on how signals are cut."""
    hop, n_fft, block = options["hop"], options["n_fft"], options["block"]
    lengths = sorted({1, hop - 1, hop, hop + 1, n_fft // 2, n_fft, 2 * n_fft + 3, block * hop, block * hop + n_fft // 2, block * hop + n_fft // 2 - 1, 3 * block * hop, 3 * block * hop + hop - 1, 2 * block * hop + n_fft // 2 + hop})
    rng = np.random.default_rng(2)
    signals = {k: (rng.normal(size=n) * (1 if k % 2 else 1e-3) + np.sin(np.arange(n) / 3)).tolist() for k, n in enumerate(lengths)}
    d = spark.createDataFrame([(k, i, v) for k, x in signals.items() for i, v in enumerate(x)], "k long, i long, x double").repartition(5)
    got = {}
    for r in spectra.log_mel(d, ["k"], rate=16000, **options).collect():
        assert (r.k, r.t) not in got
        got[r.k, r.t] = r.mel
    for k, x in signals.items():
        want = log_mel(x, n_fft, hop, options["n_mels"], 16000)
        assert sorted(t for q, t in got if q == k) == list(range(len(want)))
        for t, row in enumerate(want):
            np.testing.assert_allclose(got[k, t], row, atol=1e-6)


def test_pure_tone(spark):
    d = spark.range(16000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.sin(F.col("id") * (2 * math.pi * 1000 / 16000)).alias("x"))
    got = spectra.log_mel(d, ["k"]).collect()
    assert len(got) == 100
    mel = np.mean([r.mel for r in got], axis=0)
    peak = np.argmax(spectra.filterbank(80, 400, 16000)[np.argmax(mel)]) * 40
    assert abs(peak - 1000) < 100


def onsets(heads, n_time):
    """Normalize, smooth, average, negate, warp: all of one window by the rules."""
    heads = [np.array(h) for h in heads]
    width = 7 if n_time > 7 else min(max((n_time - 1) | 1, 1), n_time)
    half, smooth = width // 2, []
    for h in heads:
        z = (h - h.mean(0)) / np.sqrt(h.var(0) + 1e-9)
        mirror = lambda j: -j if j < 0 else 2 * (n_time - 1) - j if j >= n_time else j
        smooth.append([[statistics.median(row[mirror(t + o)] for o in range(-half, half + 1)) for t in range(n_time)] for row in z])
    cost = -np.mean(smooth, axis=0)
    n, m = cost.shape
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    step = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [d[i - 1, j - 1], d[i - 1, j], d[i, j - 1]]
            # the diagonal only if it is less than both, then what comes down if it is less than what comes along
            k = 0 if options[0] < options[1] and options[0] < options[2] else 1 if options[1] < options[0] and options[1] < options[2] else 2
            d[i, j], step[i, j] = np.float32(cost[i - 1, j - 1]) + options[k], k
    step[0, :], step[:, 0] = 2, 1
    i, j, path = n, m, []
    while i > 0 or j > 0:
        path.append((i - 1, j - 1))
        i, j = (i - 1, j - 1) if step[i, j] == 0 else (i - 1, j) if step[i, j] == 1 else (i, j - 1)
    first = {}
    for a, b in path[::-1]:
        first.setdefault(a, b)
    return cost, [max(0, first[a]) for a in range(n)]


def test_heads(spark):
    rng = np.random.default_rng(8)
    windows = {k: [rng.normal(size=(n, 16)).tolist() for _ in range(h)] for k, (n, h) in enumerate([(4, 3), (1, 1), (6, 2), (5, 4)])}
    rows = [(k, h, i, j, float(v)) for k, heads in windows.items() for h, m in enumerate(heads) for i, row in enumerate(m) for j, v in enumerate(row)]
    d = spark.createDataFrame(rows, "win long, head int, token long, time long, w double")
    cost = {(r.win, r.token, r.time): r.cost for r in spectra.heads_cost(d, ["win"], 16).collect()}
    got = {}
    for r in spectra.token_onsets(d, ["win"], 16).collect():
        got.setdefault(r.win, {})[r.token] = r.onset
    for k, heads in windows.items():
        want, times = onsets(heads, 16)
        assert [[cost[k, i, j] for j in range(16)] for i in range(len(want))] == [pytest.approx(r, abs=1e-9) for r in want.tolist()]
        assert [got[k][i] for i in range(len(want))] == times
