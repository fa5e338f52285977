"""Streams of samples fed into windows whose advance depends on what they hold; the rest stays as state of the key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequential import WINDOW_ROWS, drained

#: The state store these need; the session's owner sets spark.sql.streaming.stateStore.providerClass to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in STATE_STORE; the session's setting is put back then."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])  # workers have no session that could parse DDL


class Feeder(StatefulProcessor):
    """State of a stream: chunks of samples by the number of their first, and a few values.

    A batch writes its own chunk, and takes away those that windows have used up; what waits is read only when a window is
    full or the stream ends.
    """

    def __init__(self, key: str, window: int, least: int, last: int, idle_ms: int | None, detect: Callable[[np.ndarray], str] | None, keep: int):
        self.key, self.window, self.least, self.last = key, window, least, last
        self.idle_ms, self.detect, self.keep = idle_ms, detect, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        chunk = _fields(x=T.ArrayType(T.DoubleType()), mark=T.ArrayType(T.BooleanType()), tok=T.ArrayType(T.LongType()))
        self.chunks = handle.getMapState("chunks", _fields(first=T.LongType()), chunk)
        values = _fields(offset=T.LongType(), next=T.LongType(), timer=T.LongType(), decoded=T.BooleanType(), language=T.StringType(), context=T.ArrayType(T.LongType()))
        self.values = handle.getValueState("values", values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("i")
        offset, end, timer, *carried = self.values.get() if self.values.exists() else (0, 0, None, False, None, [])
        self.chunks.updateValue((end,), (new["x"].astype(float).tolist(), new["mark"].fillna(False).astype(bool).tolist(), [None if pd.isna(t) else int(t) for t in new["tok"]]))
        end += len(new)
        over = bool(new["ends"].fillna(False).any())
        out = []
        if over or end - offset >= self.window:
            out, offset, carried = self._drain(offset, carried, over)
        if over:
            self._clear(timer)
        else:
            if self.idle_ms is not None:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = max(int(new["ts"].max().timestamp() * 1000) + self.idle_ms, timer or 0)
                self.handle.registerTimer(timer)
            self.values.update((offset, end, timer, *carried))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for so long that the stream is done."""
        out = []
        if self.values.exists():
            offset, _, _, *carried = self.values.get()
            out, _, _ = self._drain(offset, carried, True)
            self._clear(None)
        yield self._rows(key, out)

    def _drain(self, offset: int, carried: list, over: bool):
        """Windows that can be had, and then where the first waiting sample is."""
        held = sorted(((k[0], v) for k, v in self.chunks.iterator()), key=lambda c: c[0])
        x = np.concatenate([np.array(v[0], float) for _, v in held] or [np.zeros(0)])
        m = np.concatenate([np.array(v[1], bool) for _, v in held] or [np.zeros(0, bool)])
        tok = [t for _, v in held for t in v[2]]
        skip = offset - held[0][0] if held else 0
        x, m, tok = x[skip:], m[skip:], tok[skip:]
        out, used = drained(x, m, offset, self.window, self.least, self.last if over else None)
        decoded, language, context = carried
        context, rows = list(context or []), []
        for start, length, go, mean in out:
            at = start - offset
            if not decoded and self.detect is not None:
                language = self.detect(x[at : at + length])
            rows.append((start, length, go, mean, not decoded, language, list(context)))
            decoded = True
            context = (context + [t for t in tok[at : at + go] if t is not None])[-self.keep :] if self.keep else []
        offset += used
        for first, v in held:
            if first + len(v[0]) <= offset:
                self.chunks.removeKey((first,))
        return rows, offset, [decoded, language, context]

    def _clear(self, timer) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.chunks.clear()
        self.values.clear()

    def _rows(self, key, out) -> pd.DataFrame:
        d = pd.DataFrame(out, columns=["start", "length", "advance", "mean", "first", "language", "context"])
        d.insert(0, self.key, key[0])
        return d

    def close(self) -> None:
        pass


def feed_stream(
    stream: DataFrame, key: str, window: int, least: int, last: int, *, ts: str | None = None, idle: int | None = None, detect: Callable[[np.ndarray], str] | None = None, keep: int = 0
) -> DataFrame:
    """Windows (key, start, length, advance, mean, first, language, context) of a stream of samples, as soon as they are full.

    Samples are (key, i, x, mark) and, where there are such columns, ends and tok. A stream's rest comes, while over `last`
    samples remain, with the sample that has `ends`, or, with `idle`, once the watermark of `ts` is so many seconds beyond
    its latest sample; `stream` then needs a watermark. What comes after that begins a new stream. `first` tells a
    stream's first window; `language` is what `detect` says of its samples, and stays; `context` are the last `keep` ids
    (tok) of the samples that earlier windows used up. A batch's samples are put in order by i; streams whose batches
    overlap in time need ordering before. The session has to use STATE_STORE.
    """
    fields = [stream.schema[key], *T.StructType.fromDDL(f"{WINDOW_ROWS}, first boolean, language string, context array<long>")]
    have = lambda name, kind: F.col(name) if name in stream.columns else F.lit(None).cast(kind)
    cols = [key, "i", "x", "mark", have("ends", "boolean").alias("ends"), have("tok", "long").alias("tok"), *([F.col(ts).alias("ts")] if idle is not None else [])]
    processor = Feeder(key, window, least, last, None if idle is None else idle * 1000, detect, keep)
    return stream.select(*cols).groupBy(key).transformWithStateInPandas(processor, T.StructType(fields), "Append", "None" if idle is None else "EventTime")


class Ring(StatefulProcessor):
    """The last rows of a key, by their order, and how many there were."""

    def __init__(self, n: int, order: list[str], fields: T.StructType):
        self.n, self.order, self.fields = n, order, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", T.StructType([f for f in self.fields if f.name not in ("slot", "dropped")]))
        self.count = handle.getValueState("count", _fields(n=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.fields if f.name not in ("slot", "dropped")]
        new = pd.concat(list(rows))[names]
        total = (self.count.get()[0] if self.count.exists() else 0) + len(new)
        held = pd.DataFrame(list(self.kept.get()), columns=names)
        d = (pd.concat([held, new]) if len(held) else new).sort_values(self.order, kind="stable").tail(self.n)
        self.kept.put([tuple(None if pd.isna(v) else v for v in r) for r in d.astype(object).itertuples(index=False)])
        self.count.update((total,))
        yield d.assign(slot=np.arange(len(d)), dropped=total - len(d))[[f.name for f in self.fields]]

    def close(self) -> None:
        pass


def ring_stream(stream: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """What a ring buffer of `n` holds after each batch, oldest first as slot 0, with how many rows it dropped so far.

    The columns of `stream`, then slot and dropped. State has `n` rows a key. Rows may come in any order of time: those that
    are the last by `order` stay, as in timeline.last_n. Order columns hold no nulls and tell all rows of a key apart. The
    session has to use STATE_STORE.
    """
    fields = T.StructType([*stream.schema, T.StructField("slot", T.LongType()), T.StructField("dropped", T.LongType())])
    return stream.groupBy(key).transformWithStateInPandas(Ring(n, order, fields), fields, "Append", "None")


class Activation(StatefulProcessor):
    """Two phases: the first text of a key sets the prompt it has to repeat, later ones that are near it activate.

    What was heard is as many words as the prompt has; it activates at a similarity of 0.8 or more and a length of 0.8 to
    1.2 times the prompt's. The text that set the prompt is kept, as is the one that activated.
    """

    def __init__(self, words: int):
        self.words = words

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(n, T.StringType()) for n in ("prompt", "enrolled", "heard")]
        self.state = handle.getValueState("phase", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        prompt, enrolled, heard = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for turn, text in pd.concat(list(rows)).sort_values("turn")[["turn", "text"]].itertuples(index=False):
            text = text or ""
            said = " ".join(text.lower().split(" ")[: self.words])
            if prompt is None:
                prompt, enrolled = said, text
            elif heard is None and prompt and likeness(said, prompt) >= 0.8 and 0.8 <= len(said) / len(prompt) <= 1.2:
                heard = text
            out.append((key[0], turn, heard is not None))
        self.state.update((prompt, enrolled, heard))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "active"])

    def close(self) -> None:
        pass


def likeness(a: str, b: str) -> float:
    """1 - edit distance over the longer length, as text.similarity; two empty texts are alike."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    place, row = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, c in enumerate(x):
        kept = np.append(i + 1, np.minimum(row[1:] + 1, row[:-1] + (y != c)))
        row = np.minimum.accumulate(kept - place) + place  # insertions along the row
    return 1 - row[-1] / max(len(x), len(y))


def activations(stream: DataFrame, words: int = 2) -> DataFrame:
    """(conv_id, turn, active) of a stream of texts (conv_id, turn, text), with the phase kept from batch to batch."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("active", T.BooleanType())])
    return stream.groupBy("conv_id").transformWithStateInPandas(Activation(words), schema, "Append", "None")
