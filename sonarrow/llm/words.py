"""Words and hashes of whole text columns, for the Arrow tasks of several operators.

A column of texts is cut into slices of half a MB; the words of a slice are found and hashed together in numpy. Words are
`[^\\x20\\x09-\\x0D]+` over UTF-8 bytes with A-Z in lower case. A word's hash is 64 bits, the sum over its bytes of a
random number per byte value times a power per place, mixed; two words share one with probability about 2**-64.
`word_hashes` are other ones of the same size, read eight bytes at a time, for tasks in which hashing is most of the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once, and that are hashed at once.
SLICE_BYTES, HASHED_BYTES = 1 << 19, 1 << 17
#: Bytes of the longest word that `word_hashes` reads eight at a time.
SHORT_BYTES = 128

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, U64), np.cumprod(np.full(2 * n - 1, 0x9E3779B97F4A7C15, U64), dtype=U64)])
    return _POWERS


class Slice:
    """Some texts: `data` their bytes, `at` where each begins (and the last ends), `first` the first one's row.

    `more` says that the one text it holds goes on in the next slice.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int, more: bool = False):
        self.data, self.at, self.first, self.n, self.more = data, at, first, len(at) - 1, more

    def lower(self) -> Slice:
        return Slice(_LOWER[self.data], self.at, self.first, self.more)


def _cut(data: np.ndarray, most: int) -> int:
    """The end of a part of about `most` bytes that ends with white space, or that of the text."""
    at = most
    while at < len(data):
        space = np.flatnonzero(_SPACE[data[at : at + most]])
        if len(space):
            return at + int(space[0]) + 1
        at += most
    return len(data)


def slices(column: pa.Array, most: int = SLICE_BYTES, parts: bool = False) -> Iterator[Slice]:
    """The texts of a string column (null: empty) in order, about `most` bytes at a time; a longer text is alone.

    With `parts`, a text longer than that comes in several slices, cut behind white space, so that no word is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        if parts and at[j] - at[i] > most:
            text = data[at[i] : at[j]]
            while len(text):
                end = _cut(text, most)
                yield Slice(text[:end], np.array([0, end]), i, end < len(text))
                text = text[end:]
        else:
            yield Slice(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def spans(s: Slice, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and how many words each text has."""
    n = len(s.data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(s.n, np.int64)
    inside = ~space[s.data]
    cut = np.zeros(n + 1, bool)
    cut[s.at] = True
    begins = inside.copy()
    begins[1:] &= space[s.data[:-1]] | cut[1:n]
    ends = inside
    ends[:-1] &= space[s.data[1:]] | cut[1:n]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begins, ends, np.diff(np.searchsorted(begins, s.at))


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans lie in order and don't overlap. Some 64 bytes for each byte of a span are used at once."""
    out = np.empty(len(begins), U64)
    after = np.cumsum(ends - begins)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(after, (after[i - 1] if i else 0) + HASHED_BYTES, "right")))
        out[i:j] = _hashed(data, begins[i:j], ends[i:j])
        i = j
    return out


def _hashed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - begins
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    total = int(first[-1] + lens[-1])
    place = np.arange(total, dtype=np.int64)
    place -= np.repeat(first, lens)
    where = np.repeat(begins, lens)
    where += place
    x = _BYTE[data[where]]
    x *= _powers(int(lens.max()))[place]
    return mix64(np.add.reduceat(x, first))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, as `hashes` but other ones; words of one length up to 8 bytes never share one.

    Length and eights of bytes are mixed in one after another; spans of over `SHORT_BYTES` take their `hashes`.
    """
    lens = ends - begins
    padded = np.zeros((len(data) // 8 + 3) * 8, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")
    out = mix64(lens.astype(U64) * U64(0x9E3779B97F4A7C15))
    w = np.flatnonzero(lens <= SHORT_BYTES)
    at, left = begins[w], lens[w]
    while len(w):
        i, shift = at >> 3, ((at & 7) << 3).astype(U64)
        x = eights[i] >> shift
        x |= (eights[i + 1] << (U64(63) - shift)) << U64(1)
        x &= _MASKS[np.minimum(left, 8)]
        x ^= out[w]
        out[w] = mix64(x)
        go = np.flatnonzero(left > 8)
        w, at, left = w[go], at[go] + 8, left[go] - 8
    long = np.flatnonzero(lens > SHORT_BYTES)
    if len(long):
        out[long] = hashes(data, begins[long], ends[long])
    return out


def finder(keys: np.ndarray):
    """A function that tells where each of some hashes is in the ascending hashes `keys` (or a place that is not its own), and whether it is there.

    Hashes are spread evenly, so their first bits tell nearly where they are.
    """
    bits = max(1, len(keys).bit_length())
    rest = U64(64 - bits)
    first = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << rest).astype(np.int32)
    ended = np.append(keys, U64(2**64 - 1))

    def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = first[h >> rest]
        behind = np.flatnonzero(ended[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[ended[at[behind]] < h[behind]]
        found = (ended[at] == h) & (at < len(keys))
        return np.minimum(at, max(len(keys) - 1, 0)), found

    return look


def prefixes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first `size` bytes of each span, or of the whole span if it is shorter."""
    h = np.full(len(begins), 0x51ED270B, U64)
    for k in range(size):
        at = begins + k
        ok = at < ends
        h[ok] = h[ok] * U64(0x9E3779B97F4A7C15) + _BYTE[data[at[ok]]]
    return mix64(h)
