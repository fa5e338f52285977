"""Exchange clustering: words are moved between classes while that raises the likelihood of the class bigrams."""

from __future__ import annotations

import numpy as np


def _f(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray, classes: np.ndarray, k: int) -> float:
    """What exchange raises: sum of f over class bigrams less f over class counts on either side."""
    c = np.zeros((k, k))
    np.add.at(c, (classes[:, None], classes[None, :]), pairs)
    return float(_f(c).sum() - _f(c.sum(0)).sum() - _f(c.sum(1)).sum())


def exchange(pairs: np.ndarray, k: int, fixed: np.ndarray) -> np.ndarray:
    """The class of each unit from bigram counts `pairs` (units x units).

    `fixed` holds a class for units that stay (or -1). The others start in turn, most frequent first, and each round
    moves every unit to its best class; the end comes when a round moves none. Each move raises the likelihood by a share
    of its gain at least, so that an end comes.
    """
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    free = [int(u) for u in order if fixed[u] < 0]
    open_classes = np.setdiff1d(np.arange(k), fixed[fixed >= 0])
    classes = fixed.copy()
    for i, u in enumerate(free):
        classes[u] = open_classes[i % len(open_classes)]
    to = np.zeros((n, k))  # unit -> class of what follows
    of = np.zeros((n, k))  # unit -> class of what stands before
    for c in range(k):
        to[:, c] = pairs[:, classes == c].sum(1)
        of[:, c] = pairs[classes == c].sum(0)
    grid = np.zeros((k, k))
    np.add.at(grid, classes, to)
    noise = 1e-12 * float(_f(pairs.sum()))  # below what rounding may make of the sums
    moved = 1
    while moved:
        moved = 0
        for u in free:
            a, own = classes[u], pairs[u, u]
            out, into = to[u].copy(), of[u].copy()
            out[a] -= own  # u's neighbours without u itself
            into[a] -= own
            base = grid.copy()
            base[a] -= out
            base[:, a] -= into
            base[a, a] -= own
            # the gain of putting u into each class b: rows and columns of b get u's counts
            gain = (_f(base + out[None, :]) - _f(base)).sum(1) + (_f(base + into[:, None]) - _f(base)).sum(0)
            d = np.arange(k)
            gain += _f(base[d, d] + out + into + own) - _f(base[d, d] + out) - _f(base[d, d] + into) + _f(base[d, d])
            left, right = base.sum(1) + into, base.sum(0) + out  # u's neighbours count beside it in any class
            gain -= _f(left + out.sum() + own) - _f(left) + _f(right + into.sum() + own) - _f(right)
            best = int(open_classes[gain[open_classes].argmax()])
            if best != a and gain[best] > gain[a] + 1e-6 * abs(gain[a]) + noise:
                grid = base
                grid[best] += out
                grid[:, best] += into
                grid[best, best] += own
                classes[u] = best
                to[:, a] -= pairs[:, u]
                to[:, best] += pairs[:, u]
                of[:, a] -= pairs[u]
                of[:, best] += pairs[u]
                moved += 1
    return classes


def gains(grid: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What the likelihood gains by putting each of many words into each class, all others staying where they are.

    `grid` (classes squared) are the class bigrams, `out` and `into` (words x classes) the words' neighbours after and
    before them by class, without the word itself, `own` how often it follows itself, and `now` its class. A word's counts
    are taken out of its class before any class is tried.
    """
    n, k = out.shape
    grid = grid.astype(np.float64)
    left, right, diagonal = grid.sum(1), grid.sum(0), np.diag(grid)
    gain = np.zeros((n, k))
    for side, rows in ((out, grid), (into, grid.T)):  # rows[b, j]: what class b has beside class j
        word, j = np.nonzero(side)
        if len(word):
            cells = rows.T[j]
            more = _f(cells + side[word, j][:, None]) - _f(cells)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[first]] += np.add.reduceat(more, first)
    o, i, s = out.sum(1)[:, None], into.sum(1)[:, None], own[:, None]
    cross = lambda d: _f(d + out + into + s) - _f(d + out) - _f(d + into) + _f(d)  # noqa: E731  both sides meet in a cell
    ends = lambda l, r: _f(l + o + s) - _f(l) + _f(r + i + s) - _f(r)  # noqa: E731, E741
    gain += cross(diagonal[None]) - ends(left[None], right[None])
    a, at, x, y = now, np.arange(n), out, into
    x_a, y_a = x[at, a], y[at, a]
    # for the other classes: beside class a they have lost what the word had there
    beside, before = grid[:, a].T, grid[a]  # [w, b]: class b before class a, class a before class b
    gain += _f(beside - y + x_a[:, None]) - _f(beside - y) - _f(beside + x_a[:, None]) + _f(beside)
    gain += _f(before - x + y_a[:, None]) - _f(before - x) - _f(before + y_a[:, None]) + _f(before)
    # for its own class: what would be lost without the word
    row, col = before, beside
    lost = _f(row) - _f(row - x) + _f(col) - _f(col - y)
    lost[at, a] = _f(diagonal[a]) - _f(diagonal[a] - x_a - y_a - own)
    gain[at, a] = lost.sum(1) - (_f(left[a]) - _f(left[a] - x.sum(1) - own) + _f(right[a]) - _f(right[a] - y.sum(1) - own))
    return gain
