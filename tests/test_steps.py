"""Beam search, hooks, weight tables, carried context, onset times and requests against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarrow.operators import linalg, search, text, timeline

END = 4


def searched(table, width, context, most):
    """Beam search over scores table[step][last or 0] (a list by id), with the finished pool as a list."""
    live, finished = [([], 0.0)], []
    for step in range(most):
        found = []
        for b, (ids, total) in enumerate(live):
            row = table[step][ids[-1] if ids else 0]
            best = sorted(((v, i) for i, v in enumerate(row) if v is not None), key=lambda x: (-x[0], x[1]))[:width]
            found += [(total + max(v, -30.0), b, i) for v, i in best]
        found = sorted(found, key=lambda x: -x[0])[:width]
        nxt = []
        for total, b, i in found:
            ids, old = live[b]
            if i == END:
                finished.append((ids, total))
            elif len(ids) >= context:
                finished.append((ids, old))
            else:
                nxt.append(([*ids, i], total))
        if len(finished) >= width:
            live = []
            break
        live = nxt
        if not live:
            break
    ended = len(finished)
    best = None
    for ids, total in finished + live:
        mean = total / (len(ids) + 1)
        if best is None or mean >= best[0]:
            best = (mean, ids, total)
    return best[1], round(best[2], 9), ended


@pytest.mark.parametrize("width,context,most", [(3, 9, 6), (2, 2, 9), (4, 9, 2), (1, 5, 5)])
def test_beam_search(spark, width, context, most):
    """Searches of several keys at once, with ties, clamped scores, masked ids and every way to end."""
    rng = random.Random(width * 100 + most)
    tables = {k: [[[None if rng.random() < 0.1 else rng.choice([-0.5, -1.0, -2.0, -40.0, -50.0]) - (k % 3 if i == END else 0) for i in range(6)] for _ in range(6)] for _ in range(most)] for k in range(12)}
    rows = [(k, s, last, i, v) for k, t in tables.items() for s, a in enumerate(t) for last, b in enumerate(a) for i, v in enumerate(b) if v is not None]
    scores = spark.createDataFrame(rows, "key long, step int, last long, id long, v double").cache()
    keys = spark.createDataFrame([(k,) for k in tables], "key long")

    def scores_of(live):
        return live.select("key", "beam", "step", F.coalesce("last", F.lit(0)).alias("last")).join(scores, ["key", "step", "last"]).select("key", "beam", "id", "v")

    got = search.beam_search(keys, scores_of, ["key"], width=width, end=END, context=context, most=most).collect()
    assert {r.key: (list(r.ids), round(r.total, 9), r.ended) for r in got} == {k: searched(t, width, context, most) for k, t in tables.items()}
    assert search.beam_search(keys.where("key < 0"), scores_of, ["key"], width=width, end=END, context=context, most=most).collect() == []


def test_hook(spark):
    rows = [(1, [0, 2], [1.0, None, 3.0]), (2, [], [2.0, 2.0, None]), (3, None, None), (4, [1], [5.0]), (5, [1], []), (6, [0], [None, None, None])]
    d = spark.createDataFrame(rows, "i int, past array<long>, v array<double>").coalesce(1)

    def hook(past, matrix):
        for r, ids in enumerate(past):
            matrix[r, ids[ids < matrix.shape[1]]] -= 10
        return matrix

    got = {r.i: (r.v, r.best) for r in search.filter_scores(d, "past", "v", hook).withColumn("best", search.argmax_last(F.col("v"))).collect()}
    assert got == {1: ([-9.0, None, -7.0], 2), 2: ([2.0, 2.0, None], 1), 3: (None, None), 4: ([5.0], 0), 5: ([], None), 6: ([None, None, None], None)}


def test_linear_both_ways(spark):
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(5, 7)), rng.normal(size=5)
    w[3] = 0  # an output without entries
    rows = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([7, 7, 3, 0, 9])] + [(9, None)]
    d = spark.createDataFrame(rows, "k int, x array<double>").repartition(3)
    entries = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(5) for j in range(7) if w[i, j]], "out long, pos int, w double")
    bias = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b) if i != 2], "out long, b double")
    want = {k: None if x is None else (w[:, : min(len(x), 7)] @ np.array(x[:7]) + np.where(np.arange(5) == 2, 0, b)) for k, x in rows}
    for held in (linalg.HELD, 1):
        for with_bias in (True, False):
            got = {r.k: r.y for r in linalg.linear(d, ["k"], "x", entries, bias if with_bias else None, held).collect()}
            assert got.keys() == want.keys() and got[9] is None
            for k in range(5):
                assert got[k] == pytest.approx((want[k] - (0 if with_bias else np.where(np.arange(5) == 2, 0, b))).tolist())


@pytest.mark.parametrize("most", [1, 3, 50])
def test_carried(spark, most):
    rng = random.Random(most)
    rows = [(k, i, None if rng.random() < 0.1 else [f"{k}.{i}.{j}" for j in range(rng.choice([0, 0, 1, 2, 9]))]) for k in range(6) for i in range(25)]
    got = {(r.k, r.i): r.context for r in timeline.carried(spark.createDataFrame(rows, "k int, i int, w array<string>").repartition(4), ["k"], "i", F.col("w"), most).collect()}
    for k in range(6):
        past = []
        for _, i, w in (r for r in rows if r[0] == k):
            assert got[k, i] == past[-most:]
            past += w or []


def test_onset_times(spark):
    """A window over the context, or without a matching head, is skipped as a whole; one at the limit is not."""
    tokens = spark.createDataFrame([(k, i // 3, i % 3) for k, n in ((1, 5), (2, 6), (3, 5)) for i in range(n)], "k int, seg int, at int")
    onsets = spark.createDataFrame([(k, i, i + 1) for k in (1, 2) for i in range(6)], "k int, token long, onset long")
    got = timeline.onset_times(tokens, onsets, ["k"], ["seg", "at"], F.lit(10.0), context=8, before=2).collect()
    assert {r.k: sorted(x.t_dtw for x in got if x.k == r.k) if r.k == 1 else {x.t_dtw for x in got if x.k == r.k} for r in got} == {1: pytest.approx([10 + 0.02 * i for i in range(1, 6)]), 2: {None}, 3: {None}}


def test_requests(spark):
    rows = [("application/json", '{"model":"a b"}', "a b"), ("APPLICATION/json;x", '{"x":{"model": "n"}}', "n"), ("application/json", '{"model":"a', None), ("application/json", '{"model":null,"y":"z"}', None), ("application/json", "", None)]
    rows += [(None, "  p \r\n", "p"), ("text/json", '{"model":"a"}', '{"model":"a"}'), (None, None, None), ("application/json", '{"model" "a"}', None), ("application/json", None, None)]
    got = spark.createDataFrame(rows, "kind string, body string, want string").select(text.load_path(F.col("kind"), F.col("body")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    d = spark.createDataFrame([(1, 0, " hello "), (1, 1, "\tworld\n"), (1, 2, ""), (1, 3, "x")], "k int, i int, t string")
    assert text.joined_text(d, ["k"], "i", "t").first().text == "hello world  x"
