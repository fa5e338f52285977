"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sonarrow.llm import hnsw, neighbours


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], np.float32).astype(float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ np.array(good[q], np.float32).astype(float)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST", 100)  # nine shards
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, (900, 1))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # one very common vector
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] + [1.0] * 11), (2060, [float("inf")] + [1.0] * 11), (2080, [None] + [1.0] * 11), (None, rows[5][1]), (7, rows[7][1]), (40, rows[40][1])]
    d = spark.createDataFrame([(i, v, "z", 0) for i, v in rows], "vec_id long, embedding array<float>, shard string, ids int")
    got: dict = {}
    for r in neighbours.nearest(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(own[i][2] > own[i + 1][2] or own[i][2] == own[i + 1][2] and own[i][1] < own[i + 1][1] for i in range(19))
        hits += len({i for _, i, _ in own} & {i for i, _ in w})
    assert hits / (20 * len(want)) >= 0.95


def test_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert neighbours.nearest(one, F.col("vec_id") % 20 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 1.0])], schema)
    assert [(r["rank"], r.vec_id, r.score) for r in neighbours.nearest(three, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 2, 2.0), (2, 1, 0.5)]


def test_flat_arrays():
    x = np.random.default_rng(2).normal(size=(500, 8)).astype(np.float32)
    g = hnsw.Graph.build(x)
    h = hnsw.Graph.restore(g.arrays())
    seen = np.zeros(500, np.int32)
    for k, q in enumerate(x[:20]):
        a, b = g.search(q, 40, seen, 2 * k + 1), h.search(q, 40, seen, 2 * k + 2)
        assert sorted(a.tolist()) == sorted(b.tolist())
    for row, links in g.layers:
        assert links.max() < 500 and ((row >= 0).sum() == len(links))


def test_scores_are_of_the_original_vectors(spark):
    """Doubles are not rounded to single precision, and components out of its range are searched all the same."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)) * 1e39
    x[40:] /= 1e39
    d = spark.createDataFrame([(i, [float(v) for v in r], 7, 7) for i, r in enumerate(x)], "vec_id long, embedding array<double>, Shard int, queries int")
    got = neighbours.nearest(d, F.col("vec_id") % 20 == 0).collect()
    for q in (0, 20, 40):
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(60), -s)) if j != q][:20]
        own = {r["rank"]: r for r in got if r.query_id == q}
        assert sorted(own) == list(range(1, 21)) and len({r.vec_id for r in own.values()} & {*map(int, want)}) >= 18
        assert all(np.isfinite(r.score) and r.score == s[r.vec_id] or abs(r.score - s[r.vec_id]) <= 1e-12 * abs(s[r.vec_id]) for r in own.values())


def test_recall_of_large_shards(spark, monkeypatch):
    """Four shards of 5000 random unit vectors of 64 dimensions, which have no structure that a graph could lean on."""
    monkeypatch.setattr(neighbours, "SHARDS", 4)
    x = np.random.default_rng(7).normal(size=(20_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got: dict = {}
    for r in neighbours.nearest(d, F.col("vec_id") % 200 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 200):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits / 2000 >= 0.95


def test_places(spark):
    """Nearly every pair of shard and block has a partition of its own, and every one has a place."""
    for n in (1, 8, 1000):
        rows = neighbours._apart(spark, n).selectExpr("number", "place", f"pmod(hash(place), {n}) at").collect()
        assert sorted(r.number for r in rows) == list(range(n)) and len({r["at"] for r in rows}) > 0.99 * n
