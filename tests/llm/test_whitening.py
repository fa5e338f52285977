"""Whitening against whole numbers of any size in plain Python."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonarrow.llm import whitening as w


@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=2, max_size=2), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_scatter_is_exact(rows):
    x = np.array(rows, np.int64)
    whole = [[sum(a[i] * a[j] for a in rows) for j in range(2)] for i in range(2)]
    assert w.cross(x).tolist() == whole
    assert w.sums(x).tolist() == [sum(a[i] for a in rows) for i in range(2)]
    numbers = [v for r in whole for v in r]
    back = [sum(d[k].as_py() << (w.DIGIT * i) for i, d in enumerate(w._digits(numbers))) for k in range(4)]
    assert back == numbers


def test_many_rows_at_once():
    x = np.random.default_rng(1).integers(-(2**40), 2**40, (3 * w.ROWS + 5, 3))
    y = x.astype(object)
    assert (w.cross(x) == y.T.dot(y)).all()


def brute(vectors):
    """(n, deviation of each, whitened of each, explained) by fractions and a float eigh of the exact covariance."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    dev = [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]
    mean = [Fraction(t, n) for t in s]
    cov = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    y = np.array([[float(r[k] - mean[k]) for k in range(d)] for r in x])
    keep = min(8, d)
    return n, dev, (y @ u[:, ::-1] / np.sqrt(e[::-1]))[:, :keep], e[::-1][:keep] / e.sum()


def check(rows, vectors):
    n, dev, white, share = brute(vectors)
    for k in range(white.shape[1]):
        got = np.array([r.whitened for r in rows if r.component == k + 1])
        assert [r.deviation for r in rows if r.component == k + 1] == dev
        sign = 1 if got @ white[:, k] > 0 else -1
        np.testing.assert_allclose(sign * got, white[:, k], atol=1e-7)
        assert {round(r.explained / share[k], 8) for r in rows if r.component == k + 1} == {1.0}


@pytest.mark.parametrize("scale,width", [(1.0, 10), (1e12, 3), (1e-2, 2)])
def test_whiten(spark, scale, width):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(60, width)) @ rng.normal(size=(width, width)) * scale
    vectors = [*mixed.tolist(), mixed[0].tolist()]
    odd = [None, [], [math.nan] * width, [None] * width, [math.inf] * width, [1e300] * width, [1.0]]
    rows = [(i, v, i) for i, v in enumerate(vectors + odd)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, WHITENED int").repartition(3)
    m = w.fit(d)
    assert m.n == 61 and m.width == width
    got = sorted(w.by_component(w.apply(d, m), m).collect(), key=lambda r: r.vec_id)
    check(got, vectors)
    assert set(got[0].asDict()) == {"vec_id", "embedding", "deviation", "component", "whitened", "explained"}
    assert w.identity_error(d, m) < 1e-9


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    flat = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 0.5]), (3, [-1.0, -2.0])], "vec_id long, embedding array<float>")
    for d, k in ((empty, 0), (same, 0), (flat, 1)):
        m = w.fit(d)
        assert len(m.eigenvalues) == k and w.identity_error(d, m) < 1e-9
        assert w.by_component(w.apply(d, m), m).count() == k * d.count()
    assert [r.deviation for r in w.apply(same, w.fit(same)).collect()] == [0, 0]
    # equally common widths: the least
    two = spark.createDataFrame([(1, [0.5]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert w.fit(two).width == 1


def test_deviation_beyond_64_bits(spark):
    d = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")
    assert {int(r.deviation) for r in w.apply(d, w.fit(d)).collect()} == {(1024 * 10**12 * 2) ** 2}
