"""What has to be taken in order, one stream at a time: full activity segmentation, window feeding, warping.

Spark windows do the work on rows; what is left for a fold is a row for each run or window, and the fold of a stream
holds a state of a few numbers while the sorted rows of its partition go by in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(df: DataFrame, keys: list[str], rest: str) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name in keys] + list(T.StructType.fromDDL(rest)))


def fold(df: DataFrame, keys: list[str], order: str, make: Callable, rest: str) -> DataFrame:
    """(keys, rest): the rows of each key in order through the state that `make()` gives.

    A state has take(arrays) and end(), which return lists of tuples of `rest`. Only the state of one key is held.
    """
    schema = _schema(df, keys, rest)
    columns = [c for c in df.columns if c not in keys]

    def run(batches):
        key, state = None, None

        def table(rows):
            kinds = [f.dataType for f in schema]
            arrow = {T.LongType: pa.int64(), T.DoubleType: pa.float64()}
            cols = list(zip(*[(*k, *r) for k, r in rows], strict=True)) or [()] * len(schema)
            made = [pa.array(c, like.field(f.name).type if f.name in keys else arrow[type(t)]) for c, f, t in zip(cols, schema, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        like = None
        for b in batches:
            like, out = b.schema, []
            names = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            cuts = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if state is None or names[i] != key:
                    out += [(key, r) for r in state.end()] if state is not None else []
                    key, state = names[i], make()
                part = b.slice(i, j - i)
                out += [(key, r) for r in state.take({c: part.column(c).to_numpy(zero_copy_only=False) for c in columns})]
            yield table(out)
        if state is not None:
            yield table([(key, r) for r in state.end()])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


class Spans:
    """Speech spans of one stream, before padding, from its runs of loud (1), hushed (-1) and undecided (0) windows.

    A span opens with a loud window. Once silence, counted from its first hushed window, has lasted `quiet` samples the
    span ends where the silence began; if it is longer than `least` it counts. In a span that has lasted over `most`, the
    last silence of over `brief` is where it is split, and what came after that silence goes on as a span; without such a
    silence it is split on the spot, and the window there is lost. Parts that are split off count at any length.

    Which window ends or splits a span follows by division, so that a run costs the same at any length.
    """

    def __init__(self, window: int, rate: int, total: int | None = None, min_speech_ms=250, min_silence_ms=100, max_speech_s=float("inf")):
        self.window, self.total = window, total
        self.least, self.quiet, self.brief = (rate * ms // 1000 for ms in (min_speech_ms, min_silence_ms, 98))
        self.most = 1 << 60 if max_speech_s == float("inf") else int(max_speech_s * rate)
        self.n = 0
        self._close()

    def _close(self, resumed=None):
        self.opened, self.hush, self.cut, self.back = resumed, None, None, None

    def _hushed_until(self, last: int):
        """The pending silence, seen to last up to window `last`, may be one to split at."""
        if last * self.window - self.hush > self.brief:
            self.cut, self.back = self.hush, None

    def run(self, first: int, last: int, level: int) -> Iterator[tuple[int, int]]:
        w = self.window
        self.n = last + 1
        if level > 0:
            if self.cut is not None and self.back is None:
                self.back = first * w
            self.hush = None
        while first <= last:
            if self.opened is None:
                if level <= 0:
                    return
                self.opened = first * w
                first += 1
                continue
            if level < 0 and self.hush is None:
                self.hush = first * w
            late = max(first, (self.opened + self.most) // w + 1)
            done = max(first, -(-(self.hush + self.quiet) // w)) if level < 0 else late
            if late > last and (level >= 0 or done > last):
                if level < 0:
                    self._hushed_until(last)
                return
            if done < late:
                if self.hush - self.opened > self.least:
                    yield self.opened, self.hush
                return self._close()
            if level < 0 and late > first:
                self._hushed_until(late - 1)
            yield self.opened, late * w if self.cut is None else self.cut
            first = late + 1 if self.cut is None else late
            self._close(self.back)

    def finish(self) -> Iterator[tuple[int, int]]:
        end = self.n * self.window if self.total is None else min(self.n * self.window, self.total)
        if self.opened is not None and end - self.opened > self.least:
            yield self.opened, end


class _NumberedSpans:
    def __init__(self, *args, **options):
        self.spans, self.k = Spans(*args, **options), 0

    def _numbered(self, found):
        for start, end in found:
            self.k += 1
            yield self.k, start, end

    def take(self, x):
        return [r for run in zip(x["first"].tolist(), x["last"].tolist(), x["level"].tolist(), strict=True) for r in self._numbered(self.spans.run(*run))]

    def end(self):
        return list(self._numbered(self.spans.finish()))


def levels(df: DataFrame, keys: list[str], p: str, threshold: float = 0.5) -> DataFrame:
    """(keys, first, last, level): the runs of windows (keys, i, p) at the threshold or over it, under the lower one, or between."""
    w = Window.partitionBy(*keys).orderBy("i")
    level = F.when(F.col(p) >= threshold, 1).when(F.col(p) < max(threshold - 0.15, 0.01), -1).otherwise(0)
    d = df.select(*keys, "i", level.alias("level"))
    d = d.withColumn("new", F.coalesce(F.col("level") != F.lag("level").over(w), F.lit(True)).cast("long"))
    d = d.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("level").alias("level")).drop("run")


def vad_segments(df: DataFrame, keys: list[str], p: str, window: int, rate: int, threshold: float = 0.5, **options) -> DataFrame:
    """(keys, k, start, end) in samples from (keys, i, p), i from 0 without gaps; timeline.pad adds the padding."""
    return fold(levels(df, keys, p, threshold), keys, "first", lambda: _NumberedSpans(window, rate, **options), "k long, start long, end long")


def warp(cost: np.ndarray) -> np.ndarray:
    """The cheapest monotone paths through cost matrices (matrix, token, time), all of one shape, from first to last pair.

    Returns (step, matrix, 2) with -1 before a path begins. A step is diagonal or up a token only if that is strictly
    cheapest, else it is along time. Cells of one anti-diagonal depend on the two before, so each is one array operation
    over all matrices.
    """
    k, n, m = cost.shape
    cost = cost.astype(np.float32)
    wall = np.full((k, n + 1), np.inf, np.float32)  # totals of a diagonal, by token; the time follows from its number
    older, old = wall.copy(), wall
    older[:, 0] = 0
    moves = np.zeros((n + m + 1, k, n + 1), np.int8)  # bit 0: up a token, bit 1: along time
    moves[np.arange(n + 1), :, np.arange(n + 1)] = 1  # no time is left
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        both, up, along = older[:, i - 1], old[:, i - 1], old[:, i]
        diagonal, upward = (both < up) & (both < along), (up < both) & (up < along)
        moves[d][:, i] = np.where(diagonal, 3, np.where(upward, 1, 2))
        new = wall.copy()
        new[:, i] = cost[:, i - 1, d - i - 1] + np.where(diagonal, both, np.where(upward, up, along))
        older, old = old, new
    every = np.arange(k)
    i, j = np.full(k, n), np.full(k, m)
    steps = []
    while (on := i > 0).any():
        steps.append(np.stack([np.where(on, i - 1, -1), np.where(on, np.maximum(j - 1, 0), -1)], 1))
        move = np.where(on, moves[i + j, every, i], 0)
        i, j = i - (move & 1), j - (move >> 1)
    return np.stack(steps[::-1])


def first_times(cost: np.ndarray) -> np.ndarray:
    """(matrix, token): the first time of each token on the cheapest path through cost (matrix, token, time)."""
    out = np.zeros(cost.shape[:2], np.int64)
    for step in warp(cost)[::-1]:
        on = np.flatnonzero(step[:, 0] >= 0)
        out[on, step[on, 0]] = step[on, 1]
    return out


#: Cells of cost matrices of one shape that are solved together.
CELLS = 1 << 20


def onsets(df: DataFrame, keys: list[str], token: str, time: str, cost: str) -> DataFrame:
    """(keys, token, onset): the first time of each token on the cheapest path, from (keys, token, time, cost).

    A key has one matrix, with tokens and times from 0; where a pair is missing its key has no onsets.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(token).cast("long").alias("i"), F.col(time).cast("long").alias("j"), F.col(cost).cast("float").alias("c"))))
    d = df.groupBy(*keys).agg(cells.alias("_c"), (F.max(token) + 1).cast("long").alias("_n"), (F.max(time) + 1).cast("long").alias("_m"))
    d = d.select(*keys, "_n", "_m", F.col("_c.c").alias("_c")).where(F.size("_c") == F.col("_n") * F.col("_m"))
    schema = _schema(df, keys, "_onsets array<long>")

    def run(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("_n", "_m"))
            values = b.column("_c")
            at, flat = values.offsets.to_numpy(), values.values.to_numpy()
            found: list = [None] * len(n)
            for shape in {*zip(n.tolist(), m.tolist(), strict=True)}:
                own = np.flatnonzero((n == shape[0]) & (m == shape[1]))
                step = max(1, CELLS // (shape[0] * shape[1]))
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    x = np.stack([flat[at[r] : at[r + 1]] for r in some]).reshape(len(some), *shape)
                    for r, onset in zip(some.tolist(), first_times(x), strict=True):
                        found[r] = onset
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return d.mapInArrow(run, schema).select(*keys, F.posexplode("_onsets").alias(token, "onset")).withColumn(token, F.col(token).cast("long"))


def warped(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, token, onset): each value of the array `a` warped onto the array `b` by the least absolute difference.

    A row is (keys, a, b); its matrix is only made where it is solved. Null and empty arrays have no onsets.
    """
    d = df.select(*keys, F.col(a).cast("array<double>").alias("_a"), F.col(b).cast("array<double>").alias("_b")).where((F.size("_a") > 0) & (F.size("_b") > 0))
    schema = _schema(df, keys, "_onsets array<long>")

    def run(batches):
        for batch in batches:
            x, y = batch.column("_a"), batch.column("_b")
            n, m = (c.value_lengths().to_numpy() for c in (x, y))
            u, v = (c.flatten().to_numpy(zero_copy_only=False) for c in (x, y))
            before_u, before_v = np.cumsum(n) - n, np.cumsum(m) - m
            found: list = [None] * len(n)
            for rows, columns in {*zip(n.tolist(), m.tolist(), strict=True)}:
                own = np.flatnonzero((n == rows) & (m == columns))
                step = max(1, CELLS // (rows * columns))
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    left, right = u[before_u[some][:, None] + np.arange(rows)], v[before_v[some][:, None] + np.arange(columns)]
                    for r, onset in zip(some.tolist(), first_times(np.abs(left[:, :, None] - right[:, None])), strict=True):
                        found[r] = onset
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return d.mapInArrow(run, schema).select(*keys, F.posexplode("_onsets").alias("token", "onset")).withColumn("token", F.col("token").cast("long"))


def last_advance(last: Column, least, window) -> Column:
    """How far a decoded window moves on: to its last time token if that lies at `least` or later, else by the whole window."""
    return F.when(last >= least, last).otherwise(window)


WINDOW_ROWS = "start long, length long, advance long, mean double"


class _Chain:
    """Of a window for each sample those that one reaches from the first by advancing; no state but the next start."""

    def __init__(self, window: int, last: int | None):
        self.window, self.last, self.next = window, last, 0

    def take(self, x):
        out, first = [], int(x["i"][0])
        while first <= self.next < first + len(x["i"]):
            k = self.next - first
            n, go = int(x["length"][k]), int(x["advance"][k])
            if n < self.window and (self.last is None or n <= self.last):
                self.next = -1  # what remains is kept back or dropped
                break
            out.append((self.next, n, go, float(x["mean"][k])))
            self.next += go
        return out

    def end(self):
        return []


def feed_windows(df: DataFrame, keys: list[str], x: str, mark: str, window: int, least: int, last: int | None) -> DataFrame:
    """Windows (keys, start, length, advance, mean) of whole streams (keys, i, x, mark), i from 0 without gaps.

    A window moves on to its last mark, the end of a sample that a decoder gave a time token, or by its whole length if
    that mark is nearer than `least`. With `last`, windows at the end that are not full come too while over `last`
    samples remain; without, they are kept back. Each sample's own window comes from running sums and the running last
    mark, so its cost does not grow with the window; the fold then picks those that follow one another.
    """
    w = Window.partitionBy(*keys)
    so_far = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    i = F.col("i")
    d = df.select(*keys, "i", F.col(x).alias("_x"), F.when(F.col(mark), i).alias("_at"))
    d = d.withColumns({"_sum": F.sum("_x").over(so_far), "_mark": F.max("_at").over(so_far), "_n": F.max("i").over(w) + 1, "_all": F.sum("_x").over(w), "_end": F.max("_at").over(w)})
    full = i + window <= F.col("_n")
    ahead = lambda c, rest: F.when(full, F.lead(c, window - 1).over(w.orderBy("i"))).otherwise(F.col(rest))
    d = d.withColumns({"length": F.when(full, window).otherwise(F.col("_n") - i), "_last": ahead("_mark", "_end") - i + 1, "mean": (ahead("_sum", "_all") - F.col("_sum") + F.col("_x"))})
    advance = F.least(last_advance(F.coalesce(F.when(F.col("_last") > 0, F.col("_last")), F.lit(0)), least, F.lit(window)), F.col("length"))
    d = d.select(*keys, "i", F.col("length").cast("long").alias("length"), advance.cast("long").alias("advance"), (F.col("mean") / F.col("length")).alias("mean"))
    return fold(d, keys, "i", lambda: _Chain(window, last), WINDOW_ROWS)


def drained(x: np.ndarray, marks: np.ndarray, offset: int, window: int, least: int, last: int | None = None):
    """Windows (start, length, advance, mean) at the front of a buffer, and how many samples they use up; see feed_windows."""
    out, at = [], 0
    while len(x) - at >= window or (last is not None and len(x) - at > last):
        n = min(window, len(x) - at)
        own = np.flatnonzero(marks[at : at + n])
        go = int(own[-1]) + 1 if len(own) else 0
        go = min(go if go >= least else window, n)
        out.append((offset + at, n, go, float(x[at : at + n].mean())))
        at += go
    return out, at


def uniforms(seed: int, n: int) -> list[float]:
    """Numbers from 0 to below 1 of the 64-bit linear congruential generator that sampling draws from."""
    s, out = seed, []
    for _ in range(n):
        s = (s * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append((s >> 40) / 2**24)
    return out
