"""Packing documents into windows of a fixed number of tokens by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. Whole windows are cut off its front; what remains is cut into items of at most
an eighth of a window. Each task gathers items until they fill `WINDOWS` windows and packs them: every item starts as a
partial partition with one loaded window, and the two partitions of largest imbalance are merged again and again, the
heavy windows of one onto the light ones of the other, until one partition with near-equal windows is left. If a window
then exceeds the capacity, the number of windows rises by one and the items are packed anew. Nothing is shuffled, and a
task holds one group of items at a time; windows of two tasks never mix, which costs each task a window at most.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import column, tidy
from .chunks import Memory
from .words import hashes, slices, spans

CAPACITY, WINDOWS, END = 2048, 128, 1
#: Words that are encoded at once.
BATCH = 2048
#: Items of a window that an item's size allows for.
PARTS = 8


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for k windows: the window of each item, and the windows' loads."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()] + [0] * (k - 1))
    loads: list = [None] * n  # of each live partial partition, descending
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        x = np.zeros(k, np.int64)
        x[0] = s
        loads[i] = x
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x = loads[a] + loads[b][::-1]
        order = np.argsort(-x, kind="stable")
        x = x[order]
        loads[a] = loads[b] = None
        loads.append(x)
        merged.append((a, b, order))
        heapq.heappush(heap, (int(x[-1] - x[0]), n + len(merged) - 1))
    final: list = [None] * (n + len(merged))
    final[-1] = np.arange(k)
    for m in range(len(merged) - 1, -1, -1):
        a, b, order = merged[m]
        place = np.empty(k, np.int64)
        place[order] = final[n + m]
        final[a], final[b] = place, place[::-1]
        final[n + m] = None
    return np.array([final[i][0] for i in range(n)]), loads[-1]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item, and how many there are: the fewest that hold them all, or more if differencing needs them."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, loads = differencing(sizes, k)
        if loads.max() <= capacity:
            return window, k
        k += 1


_MEMORY: dict = {}


def _memory(path: str) -> Memory:
    """The worker's memory of what this tokenizer makes of words: its pre-tokens never go over ASCII white space."""
    if path not in _MEMORY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share out the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def ids(words: list[bytes]) -> list[list[int]]:
            out = []
            for i in range(0, len(words), BATCH):  # what the tokenizer returns is large beside its ids
                out += [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[i : i + BATCH]], add_special_tokens=False)]
            return out

        _MEMORY[path] = Memory(ids)
    return _MEMORY[path]


def _token_ids(column, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of texts: its first row, its ids (each text's with the end id), and where each text's begin."""
    memory = _memory(path)
    before: list[np.ndarray] = []  # ids of the parts of a long text
    for s in slices(column, parts=True):
        begins, ends, n = spans(s)
        ids, per = memory.flat(memory.look(s.data, begins, ends, hashes(s.data, begins, ends)))
        if s.more:
            before.append(ids.astype(np.uint32))
            continue
        after = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(n)])]  # ids before each text
        at = after + np.arange(len(after))  # an end id follows each text
        out = np.full(int(at[-1]), END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[at[1:] - 1] = False
        out[keep] = ids
        if before:
            out, before = np.concatenate([*before, out]), []
            at = np.array([0, len(out)])
        yield s.first, out, at


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, tokenizer: str | None = None, id_col="doc_id", text_col="text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a tokenizers file whose pre-tokenizer splits at white space, on every executor. Null and
    empty texts are a piece of the end id alone. Rows of equal id are documents of their own. An empty table has no
    pieces. Long texts are read in parts, cut into many windows and never split among tasks; a task holds the ids of
    the longest text. Other columns of `docs`, whatever their names, are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    d = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    kind = d.schema["_id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(SCHEMA)])
    item = max(1, capacity // PARTS)

    def run(batches):
        next_id = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # arrays (doc, start, length, doc_tokens) with their ids and document ids
        tokens = 0

        def flush():
            nonlocal next_id, held, tokens
            names, ids, first, start, length, total = [], [], [], [], [], []
            shift = rows = 0
            for doc_names, x, at in held:
                n = np.diff(at)
                whole = n // capacity
                rest = n - whole * capacity
                small = -(-rest // item)
                count = whole + small
                doc = np.repeat(np.arange(len(n)), count)
                j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                is_whole = j < whole[doc]
                s = np.where(is_whole, j * capacity, whole[doc] * capacity + (j - whole[doc]) * item)
                length.append(np.where(is_whole, capacity, np.minimum(item, n[doc] - s)))
                start.append(s)
                first.append(at[doc] + s + shift)
                total.append(n[doc])
                names.append((doc_names, doc))
                ids.append(x)
                shift += len(x)
                rows += len(doc)
            held, tokens = [], 0
            first, start, length, total, ids = map(np.concatenate, (first, start, length, total, ids))
            full = length == capacity
            window, k = windows(length[~full], capacity)
            seq = np.empty(rows, np.int64)
            seq[~full] = window
            seq[full] = k + np.arange(int(full.sum()))
            used = k + int(full.sum()) if len(window) else int(full.sum())
            if not len(window):
                seq -= k
            order = np.argsort(seq, kind="stable")
            run_length = length[order]
            before = np.cumsum(run_length) - run_length
            new = np.flatnonzero(np.diff(seq[order], prepend=-1))
            offset = np.empty(rows, np.int64)
            offset[order] = before - np.repeat(before[new], np.diff(np.append(new, rows)))
            raw = ids.astype("<u4")
            cut = [raw[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            id_column = pa.chunked_array([a.take(pa.array(d)) for a, d in names]).combine_chunks()
            got = [id_column, pa.array(start), pa.array(length), pa.array(cut, pa.binary()), pa.array(total), pa.array(seq + next_id), pa.array(offset)]
            next_id += used
            return pa.RecordBatch.from_arrays(got, names=schema.names)

        for b in batches:
            doc_ids = b.column("_id")
            for at_row, ids, at in _token_ids(b.column("_text"), tokenizer):
                i = 0
                n = len(at) - 1
                while i < n:  # cut the slice where a group is full
                    j = min(n, int(np.searchsorted(at, at[i] + WINDOWS * capacity - tokens, "left")))
                    j = max(j, i + 1)
                    held.append((doc_ids.slice(at_row + i, j - i), ids[at[i] : at[j]], at[i : j + 1] - at[i]))
                    tokens += int(at[j] - at[i])
                    i = j
                    if tokens >= WINDOWS * capacity:
                        yield flush()
        if held:
            yield flush()

    return d.mapInArrow(tidy(run), schema)
