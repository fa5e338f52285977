"""Mixing: targets against the written-out rule, copies against systematic sampling in Python."""

import re
from math import floor

import pytest

from sonarrow.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def written_out(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight, stop what is above its limit, reshare the excess, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s]}
        if not over:
            return t | {s: most * sizes[s] for s in stopped}
        stopped |= over


def rows(spark, docs):
    return spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in docs], SCHEMA)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 5, "d": 7, None: 4}, {"a": 5, "b": 0, "c": 900, "d": 20, "e": 33}, {"a": 1}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long"), share=1.0)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(written_out(sizes, share=1.0))
    got = mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long"))
    assert {r.source: r.target for r in got.collect()} == pytest.approx(written_out(sizes))


def test_mix(spark):
    docs = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    docs += [(1000, None, "s1"), (1001, "", "s2"), (1002, "long " * 3000, "s3"), (None, "no id here", "s0"), (7, "again", "s4"), (7, "again", "s4"), (1003, "only", "lone")]
    got = mixing.mix(rows(spark, docs)).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = written_out(sizes), dict.fromkeys(sizes, 0)
    largest = {s: max(r["size"] for r in got if r.source == s) for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert floor(rate) <= r.copies <= min(2, floor(rate) + 1)
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(rows(spark, docs[::-1]).repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], str(r.source), r.copies)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_emit_and_empty(spark):
    docs = [(i, f"text {i} " * (i % 9 + 1), f"s{i % 3}") for i in range(90)] + [(5, "twin", "s0")] * 3 + [(None, None, None)]
    d = rows(spark, docs)
    copies = {}
    for r in mixing.mix(d).collect():
        k = (r.doc_id, r.text_hash, r.source)
        copies[k] = copies.get(k, 0) + r.copies
    out = mixing.emit(d)
    assert out.columns == d.columns
    assert out.count() == sum(copies.values())
    none = rows(spark, [])
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


def test_clashing_columns(spark):
    rows = [(i, f"w{i} " * (i % 5 + 1), "ab"[i % 2], 7, 7, 7, 7) for i in range(30)] + [(3, None, None, 7, 7, 7, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, Row int, hash int, size int")
    got = mixing.emit(d)
    assert got.columns == d.columns and {r.size for r in got.collect()} == {7}
    assert mixing.emit(d.where("doc_id < 0")).count() == 0
    taken = {r.doc_id: r.copies for r in mixing.mix(d).where("source is not null").collect()}
    assert {k: n for k, n in taken.items() if n} == {r.doc_id: r["count"] for r in got.where("source is not null").groupBy("doc_id").count().collect()}


def test_twins_are_told_apart_by_their_texts(spark):
    """Rows of equal id and size keep their copies in every rerun, however the table is dealt."""
    rows = [(i % 3, f"word{i}", "s") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r.doc_id, r.text) for r in mixing.emit(d.repartition(n)).collect()) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]
