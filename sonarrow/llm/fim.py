"""Fill-in-middle: cut each text in three and put the middle last, between sentinels, so that a model learns to fill gaps.

A text is cut by units. One Aho-Corasick automaton holds the ASCII characters at which the class of characters changes and
the sentinels; it runs over the text once, and between two of its events all characters are of one class, so a gap's units
are counted by arithmetic, not one by one. A cut after r units is looked up in the running sums over the gaps. Texts that
hold a sentinel are left plain, so the three parts can always be told from the output.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import append, column

SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts those that are transformed, and of those the ones with the suffix first; the seed of the draws.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1
#: Bytes of text that are made Python strings at once.
PART_BYTES = 1 << 20

_SPACES, _MARKS = " \t\n\v\f\r", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: By kind of unit: whether each character between events is a unit, or all of a gap are one; then the characters that
#: change the class: those that are a unit each, and those that go with the unit before them.
UNITS = {"char": (True, "", ""), "word": (False, "", _SPACES), "line": (False, "", "\n"), "piece": (False, _MARKS, _SPACES)}


class Scanner:
    """Finds units and sentinels by one automaton."""

    def __init__(self, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS):
        import ahocorasick

        self.each, units, joined = UNITS[unit]
        self.automaton = ahocorasick.Automaton()
        for c in joined:
            self.automaton.add_word(c, 0)
        for c in units:
            self.automaton.add_word(c, 1)
        for s in sentinels:
            self.automaton.add_word(s, -1)
        self.automaton.make_automaton()

    def gaps(self, text: str) -> tuple[list[int], list[int], bool]:
        """Where each gap that has units begins, the units before each gap and after the last, and whether there is a sentinel."""
        begins, before, at, n, sentinel = [], [0], 0, 0, False

        def gap(end):
            nonlocal n
            if end > at:
                begins.append(at)
                n += end - at if self.each else 1
                before.append(n)

        for end, kind in self.automaton.iter(text):
            if kind < 0:  # its characters are units like others
                sentinel = True
                continue
            gap(end)
            if kind:
                begins.append(end)
                n += 1
                before.append(n)
            at = end + 1
        gap(len(text))
        return begins, before, sentinel

    def place(self, text: str, begins: list[int], before: list[int], rank: int) -> int:
        """Where the text is cut after `rank` units; what comes before the first unit goes with it."""
        if rank == 0:
            return 0
        if rank >= before[-1]:
            return len(text)
        g = bisect_right(before, rank) - 1
        return begins[g] + rank - before[g]  # in a gap of one unit that is the gap's begin


def transform(text: str, draw, scanner: Scanner, sentinels=SENTINELS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix and of the middle, output) of one text under four drawn numbers."""
    begins, before, sentinel = scanner.gaps(text)
    n = before[-1]
    if not n or sentinel or draw[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(scanner.place(text, begins, before, d % (n + 1)) for d in draw[:2])
    p, s, m = sentinels
    if draw[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def draws(id_col: Column, seed: int = SEED) -> Column:
    """16 bytes, four big-endian numbers, that depend on seed and id alone; a null id counts as an empty one."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 32))


def _apart(sentinels) -> None:
    """Sentinels that overlap could be found where none was put."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or i != j and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError("sentinels must be three different strings of which none is part of another or begins as one ends")


def fill_in_middle(
    docs: DataFrame, *, unit="char", sentinels: tuple[str, str, str] = SENTINELS, rate=RATE, suffix_first=SUFFIX_FIRST, seed=SEED, id_col="doc_id", text_col="text", drop: tuple[str, ...] = ()
) -> DataFrame:
    """`docs` without `drop`, with n_units long, form string, prefix_chars and middle_chars long, fim_text string.

    Two drawn numbers of units cut a text in prefix, middle and suffix. `fim_text` is the text (form plain), or
    P prefix S suffix M middle (psm), or S suffix P prefix M middle (spm), by the draws; plain are also texts without units
    (null texts, which count as empty, and empty ones) and those that hold a sentinel. prefix_chars and middle_chars are in
    code points and null in plain ones. Rows of equal id and text get equal values; a null id draws as an empty one. An
    empty table gives an empty one. These columns replace those of `docs` with their names; other names do not matter.
    Texts are worked on one by one, and a task holds a few times its longest.
    """
    _apart(sentinels)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def make():
        scanner = Scanner(unit, sentinels)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

        def f(texts, drawn):
            got = [[pa.array([], k)] for k in kinds]
            for i, j in _parts(_sizes(texts)):
                raw = texts.slice(i, j - i).cast(pa.binary()).to_pylist()
                four = np.frombuffer(b"".join(drawn.slice(i, j - i).to_pylist()), ">u4").reshape(-1, 4).tolist()
                rows = [transform((x or b"").decode("utf-8", "surrogateescape"), d, scanner, sentinels, rate, suffix_first) for x, d in zip(raw, four, strict=True)]
                for k, (kind, values) in enumerate(zip(kinds, zip(*rows, strict=True), strict=True)):
                    got[k].append(pa.array([v.encode("utf-8", "surrogateescape") for v in values], pa.binary()).view(kind) if k == 4 else pa.array(values, kind))
            return [pa.concat_arrays(x) for x in got]

        return f

    return append(docs, text_col, make, "n_units long, form string, prefix_chars long, middle_chars long, fim_text string", drop, beside=draws(column(id_col), seed))


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)


def _parts(size: np.ndarray):
    """Ranges of rows of about PART_BYTES each; a longer text is alone."""
    after, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(after, (after[i - 1] if i else 0) + PART_BYTES, "right")))
        yield i, j
        i = j


def restore(df: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS, form_col="form", fim_col="fim_text", out="restored") -> DataFrame:
    """`df` with the exact text before `fill_in_middle`, from form and output alone; a null of either gives null.

    `out` replaces a column of `df` with its name. Only built-in functions are used.
    """
    text, form = column(fim_col), column(form_col)
    part = F.split(text, "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", s) for s in sentinels), -1)
    order = F.when(form == "psm", F.array(part[1], part[3], part[2])).when(form == "spm", F.array(part[2], part[3], part[1]))
    value = F.when(form == "plain", text).otherwise(F.array_join(order, ""))
    return df.select(*[column(c) for c in df.columns if c.lower() != out.lower()], value.alias(out))
