"""Signatures for sets at a Jaccard similarity: the universe cut into segments, exact ones and one-deletion ones.

Two sets of sizes s <= t with |x & y| / |x | y| >= num / den differ in at most H = (s + t)(den - num) / (den + num)
elements. Sizes fall into bands; in a band, whose H is that of its largest pair, elements are dealt to segments by hash.
A segment whose part must be equal to count takes one unit of the universe and holds against one difference; one that also
counts if the parts differ by one element takes two units and holds against two. With more units than differences some
segment must count, so sets that share no signature cannot be similar.

Parts may be empty by chance, and all sets with an empty part would share that signature. A band has `spare` more units
than it needs, and a set with at most `spare` empty exact segments leaves those out: of two such sets at most `spare`
units are lost to segments empty in both. A set with more of them keeps all.

How many segments are of which kind, and how many units are spare, is chosen for each band by cost: signatures written
plus the partners that empty or nearly empty parts would bring.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

import numpy as np

from .words import U64, mix64

#: A band's sizes go up by this factor; below `FIRST` only equal sets are similar at the thresholds used here.
GROWTH = 1.25
#: Sets for which the cost of partners by chance is weighed.
CROWD = 1e7


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int  # exclusive
    differences: int
    pairs: int  # segments of two units that take one deletion
    spare: int

    @property
    def units(self) -> int:
        return self.differences + 1 + self.spare

    @property
    def exact(self) -> int:
        return self.units - 2 * self.pairs


def differences(s: int, t: int, num: int, den: int) -> int:
    return (s + t) * (den - num) // (den + num)


def _cost(low: int, high: int, units: int, pairs: int, spare: int) -> float:
    unit, exact, middle = low / units, units - 2 * pairs, (low + high) / 2
    rows = exact + pairs * (1 + 2 * middle / units)
    if units == 2 * pairs == 2 or units == exact == 1:
        return rows  # the whole set, which is not empty
    thin = exp(-2 * unit) * (1 + 2 * unit)
    mean, term, some = exact * exp(-unit), exp(-exact * exp(-unit)), 0.0
    for k in range(spare + 1):
        some += term
        term *= mean / (k + 1)
    return rows + CROWD * (pairs * thin**2 + max(0.0, 1 - some) ** 2)


def bands(largest: int, num: int, den: int) -> list[Band]:
    """The bands for sizes up to `largest`, from the first size that has partners other than equal sets."""
    low = 1
    while differences(low, low * den // num, num, den) == 0:
        low += 1
    out: list[Band] = []
    while low <= largest:
        high = max(low + 1, int(low * GROWTH))
        h = differences(high - 1, (high - 1) * den // num, num, den)
        plans = [(_cost(low, high, h + 1 + spare, pairs, spare), spare, pairs) for spare in range(4) for pairs in range(min(3, (h + 1 + spare) // 2) + 1)]
        _, spare, pairs = min(plans)
        out.append(Band(len(out), low, high, h, pairs, spare))
        low = high
    return out


def _salted(sums: np.ndarray, band: Band, segment: np.ndarray) -> np.ndarray:
    return mix64(sums ^ mix64(segment.astype(U64) + U64(band.number << 32 | 0x7F4A)))


def signatures(x: np.ndarray, band: Band) -> np.ndarray:
    """The signatures of the set `x` (hashes, ascending) in `band`."""
    unit = ((x >> U64(32)) * U64(band.units)) >> U64(32)
    paired = U64(2 * band.pairs)
    segment = np.where(unit < paired, unit >> U64(1), unit - U64(band.pairs)).astype(np.int64)
    g = mix64(x ^ U64(0x2545F4914F6CDD1D))
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    sums, own = np.add.reduceat(g, first), segment[first]
    out = [_salted(sums, band, own)]
    n_pairs = int(np.searchsorted(own, band.pairs))
    if band.pairs:
        end = int(np.searchsorted(segment, band.pairs))
        if end:
            count = np.diff(np.append(first[:n_pairs], end))
            out.append(_salted(np.repeat(sums[:n_pairs], count) - g[:end], band, segment[:end]))
        missing = np.setdiff1d(np.arange(band.pairs), own[:n_pairs])
        out.append(_salted(np.zeros(len(missing), U64), band, missing))
    if band.exact - (len(own) - n_pairs) > band.spare:
        missing = np.setdiff1d(np.arange(band.pairs, band.pairs + band.exact), own[n_pairs:])
        out.append(_salted(np.zeros(len(missing), U64), band, missing))
    return np.concatenate(out)


class Signer:
    """All signatures of sets: those of a set's own band, and of the band below if a partner may lie there."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bands = num, den, bands(1 << 12, num, den)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        while self.bands[-1].high <= n:
            self.bands = bands(2 * n, self.num, self.den)
        if n < self.bands[0].low and n * self.den // self.num < self.bands[0].low:
            return np.zeros(0, U64)
        k = int(np.searchsorted([b.low for b in self.bands], n, "right")) - 1
        out = [signatures(x, self.bands[k])] if k >= 0 else []
        if k > 0 and -(-n * self.num // self.den) < self.bands[k].low:
            out.append(signatures(x, self.bands[k - 1]))
        return np.concatenate(out)
