"""A per-worker memory of what texts' chunks (words, say) become, so that each distinct chunk is computed once or seldom.

A chunk is found by its 64-bit hash, in sorted arrays. The memory of a worker is bounded in bytes: what it held is dropped
when it is full. Results never depend on what it holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import U64

#: Bytes of hashes, places and values that a worker remembers at most.
MOST_BYTES = 32 << 20


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `wanted` would be in the ascending `keys`, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class _Index:
    """Chunk hashes in ascending order with the chunks' numbers."""

    def __init__(self, keys=np.zeros(0, U64), numbers=np.zeros(0, np.int32)):
        self.keys, self.numbers = keys, numbers

    def merged(self, keys: np.ndarray, numbers: np.ndarray) -> _Index:
        k = np.concatenate([self.keys, keys])
        order = np.argsort(k, kind="stable")  # two ascending runs
        return _Index(k[order], np.concatenate([self.numbers, numbers])[order])


class Memory:
    """Maps chunk bytes to a list of numbers of kind `dtype` by `compute`, which gets lists of new chunks."""

    def __init__(self, compute: Callable[[list[bytes]], list], dtype=np.int32, most_bytes: int = MOST_BYTES):
        self.compute, self.dtype, self.most = compute, dtype, most_bytes
        self.clear()

    def clear(self):
        self.old, self.fresh = _Index(), _Index()  # few are merged into many only now and then
        self.n = self.used = 0
        self.values = np.zeros(1 << 12, self.dtype)
        self.at = np.zeros(1 << 12, np.int64)

    @property
    def bytes(self) -> int:
        return self.values.nbytes + self.at.nbytes + self.n * 12

    def _append(self, lists: list) -> np.ndarray:
        """The numbers of new chunks whose values are `lists`."""
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((y for x in lists for y in x), self.dtype, int(lens.sum()))
        n, end = self.n, self.used + len(flat)
        if end > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(end, self.dtype)])
        if n + len(lists) + 1 > len(self.at):
            self.at = np.concatenate([self.at[: n + 1], np.zeros(n + len(lists) + 1, np.int64)])
        self.values[self.used : end] = flat
        self.at[n + 1 : n + len(lists) + 1] = self.used + np.cumsum(lens)
        self.used, self.n = end, n + len(lists)
        return np.arange(n, self.n, dtype=np.int32)

    def look(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each chunk; `flat` turns numbers into values until the next look."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.bytes > self.most:
            self.clear()
        at, known = _found(self.old.keys, distinct)
        number = np.full(len(distinct), -1, np.int32)
        number[known] = self.old.numbers[at[known]]
        rest = np.flatnonzero(~known)
        at, known = _found(self.fresh.keys, distinct[rest])
        number[rest[known]] = self.fresh.numbers[at[known]]
        new = rest[~known]
        if len(new):
            where = first[new]
            chunks = [data[a:b].tobytes() for a, b in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
            number[new] = self._append(self.compute(chunks))
            self.fresh = self.fresh.merged(distinct[new], number[new])
            if len(self.fresh.keys) > max(1 << 14, len(self.old.keys) >> 3):
                self.old, self.fresh = self.old.merged(self.fresh.keys, self.fresh.numbers), _Index()
        return number[inverse]

    def flat(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of chunks one after another, and how many each has."""
        n = self.at[number + 1] - self.at[number]
        if not len(n):
            return np.zeros(0, self.dtype), n
        before = np.cumsum(n) - n
        where = np.arange(int(n.sum()))
        where += np.repeat(self.at[number] - before, n)
        return self.values[where], n
