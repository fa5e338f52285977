"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import U64, hashes, mix64, slices, spans

_ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)]


def _joined(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes."""
    n = len(h) - size + 1
    x = np.full(n, U64(size))
    for j in range(size):
        x = x * _ODD[j % 5] + h[j : j + n]
    return mix64(x)


def sets(column, size: int) -> Iterator[np.ndarray]:
    """The distinct `size`-word shingles of each text, ascending; a text of fewer words has its whole sequence as one."""
    before: list[np.ndarray] = []  # word hashes of the parts of a long text
    for s in slices(column, parts=True):
        s = s.lower()
        begins, ends, n = spans(s)
        h = hashes(s.data, begins, ends)
        if s.more:
            before.append(h)
            continue
        if before:
            h, before = np.concatenate([*before, h]), []
            n = np.array([len(h)])
        runs = _joined(h, size) if len(h) >= size else None
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                x = runs[a : b - size + 1].copy()
                x.sort()
                yield x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x
            elif b > a:
                yield _joined(h[a:b], b - a)
            else:
                yield h[:0]


def set_hash(x: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix64(np.array([mix64(x ^ U64(0x5DEECE66D)).sum(dtype=U64)], U64)).view(np.int64)[0])


def parity(x: np.ndarray) -> np.ndarray:
    """Of each of B buckets whether it holds an odd number of elements, as bits; B is a power of two of at least 2n."""
    b = max(64, 1 << (2 * len(x) - 1).bit_length())
    odd = np.bincount((x & U64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their parities; the longer one folds onto the shorter."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def close_pairs(size: np.ndarray, sketches: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels that parities and sizes do not rule out, each once."""
    words = np.array([len(s) for s in sketches])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(words).tolist():
        own = np.flatnonzero(words == n)
        more = np.flatnonzero(words > n)
        every = np.concatenate([own, more])
        a = np.stack([sketches[i] for i in own])
        b = np.concatenate([a, *[np.bitwise_xor.reduce(sketches[i].reshape(-1, n), axis=0)[None] for i in more]])
        step = max(1, (4 << 20) // (8 * n * len(b)))
        for at in range(0, len(own), step):
            p = own[at : at + step]
            both = size[p][:, None] + size[every][None, :]
            ok = labels[p][:, None] != labels[every][None, :]
            ok &= np.minimum(size[p][:, None], size[every][None, :]) * den >= np.maximum(size[p][:, None], size[every][None, :]) * num
            ok &= np.arange(len(every))[None, :] > np.arange(at, at + len(p))[:, None]
            if ok.any():
                d = np.bitwise_count(a[at : at + step][:, None, :] ^ b[None]).sum(axis=2, dtype=np.int64)
                ok &= d * (den + num) <= both * (den - num)
                i, j = np.nonzero(ok)
                left.append(p[i])
                right.append(every[j])
    return np.concatenate(left), np.concatenate(right)
