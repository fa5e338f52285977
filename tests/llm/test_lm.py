"""Language-model scores against counts by hand, and exchange clustering against full likelihoods."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarrow.llm import brown, lm, words

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return W.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + ["</>"]


def corpus():
    rng = random.Random(3)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(x for _ in range(rng.randrange(1, 30)) for x in (rng.choice(["The", "a"]), rng.choice(nouns), rng.choice(verbs)))) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (1002, "unseen words Here"), (1003, "the " * 20000), (None, "n1 n2"), (7, "twin twin"), (7, "twin twin")]


@pytest.mark.parametrize("head", [None, 12])
def test_scores(spark, monkeypatch, head):
    if head:  # most words then go through the join
        monkeypatch.setattr(lm, "HEAD", head)
    rows = corpus()
    d = spark.createDataFrame([(i, t, "a", 1.5) for i, t in rows], "doc_id long, text string, word string, c double").repartition(3)
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, F.lit(False))
    got = lm.lm_scores(d, train).collect()
    assert len(got) == len(rows)
    c = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(x := tokens(t)), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 and r.n_tokens > 4]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def trained(spark, rows):
    from sonarrow.llm.staging import Stage

    d = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("text").alias("_text"))
    m, words = lm.train(d, Stage(spark, "t"))
    found = {np.uint64(r.word % 2**64): (r.c, r["class"]) for r in words.collect()}
    found |= {h: (int(c), int(k)) for h, c, k in zip(m.words, m.counts, m.classes, strict=True) if k != lm.REST}
    return m, found


def hashed(text):
    import pyarrow as pa

    ((h, _),) = lm._tokens(pa.array([text]))
    return h


@pytest.mark.parametrize("head", [None, 12])
def test_class_scores(spark, monkeypatch, head):
    """Scores against the model written out word by word; after any class the probabilities of all words and an unseen one sum to 1."""
    if head:
        monkeypatch.setattr(lm, "HEAD", head)
        monkeypatch.setattr(lm, "FREQUENT", 6)
    m, found = trained(spark, corpus())
    assert len(found) == m.distinct and {k for _, k in found.values()} <= set(range(lm.CLASSES))
    size = {k: sum(c for c, x in found.values() if x == k) for k in range(lm.CLASSES)}
    words = {k: sum(x == k for _, x in found.values()) for k in range(lm.CLASSES)}
    emit = lambda c, k: (c + 0.5) / (size[k] + 0.5 * (words[k] + 1))
    after = 10**m.transition
    unseen = [sum(after[p][k] * emit(0, k) for k in range(lm.CLASSES)) for p in range(lm.CLASSES + 1)]
    for p in range(lm.CLASSES + 1):
        assert sum(after[p][k] * emit(c, k) for c, k in found.values()) + unseen[p] == pytest.approx(1)
    d = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.lm_scores(d, F.lit(True)).collect()}
    extra = spark.createDataFrame([(1, "n1 nothing like it n2")], "doc_id long, text string")
    from sonarrow.llm.staging import Stage

    stage = Stage(spark, "t")
    m2, table = lm.train(d.select(F.col("text").alias("_text")), stage)
    got[1, 6] = lm.score(extra, m2, table, stage).first().score
    for i, t in [*corpus()[:40], *corpus()[-7:], (1, "n1 nothing like it n2")]:
        before, want = 0, 0.0
        for w in [*(hashed(t) if tokens(t)[:-1] else []), np.uint64(lm.END)]:
            c, k = found.get(w, (0, lm.UNSEEN))
            want += math.log10(unseen[before] if k == lm.UNSEEN else after[before][k] * emit(c, k))
            before = k
        assert got[i, len(tokens(t))] == pytest.approx(want)


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(2)
    n, k = 14, 4
    pairs = rng.poisson(2.0, (n, n)).astype(float)
    classes = rng.integers(0, k, n)
    grid = np.zeros((k, k))
    np.add.at(grid, (classes[:, None], classes[None, :]), pairs)
    side = lambda x: np.stack([x[:, classes == c].sum(1) for c in range(k)], 1)
    alone = pairs * (1 - np.eye(n))
    got = brown.gains(grid, side(alone), side(alone.T), np.diag(pairs), classes)
    for w in range(n):
        likely = [brown.likelihood(pairs, np.where(np.arange(n) == w, c, classes), k) for c in range(k)]
        assert np.allclose(got[w] - got[w].max(), np.array(likely) - max(likely), atol=1e-8)


@pytest.mark.parametrize("head", [None, 30])
def test_every_word_has_its_best_class(spark, monkeypatch, head):
    """The class of each further word against the likelihood of the class bigrams, neighbours counted as the pass counts them."""
    from sonarrow.llm.staging import Stage

    monkeypatch.setattr(lm, "FREQUENT", 8)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    if head:
        monkeypatch.setattr(lm, "HEAD", head)
    m, found = trained(spark, corpus())
    text = [w for _, t in corpus() for w in [*(hashed(t) if tokens(t)[:-1] else []), np.uint64(lm.END)]]
    frequent = {w: int(k) for w, k, f in zip(m.words, m.classes, m.frequent, strict=True) if f}
    know = lambda w: frequent.get(w, lm.REST)
    pairs = collections.Counter(zip([np.uint64(lm.END), *text[:-1]], text, strict=True))
    for w in [w for w in found if w not in frequent][:25]:
        best, gain = None, []
        for k in range(1, lm.CLASSES):
            g = np.zeros((lm.BEFORE, lm.BEFORE))
            for (a, b), c in pairs.items():
                g[k if a == w else know(a), k if b == w else know(b)] += c
            gain.append((brown._f(g).sum() - brown._f(g.sum(0)).sum() - brown._f(g.sum(1)).sum()))
        best = 1 + int(np.argmax(gain))
        assert found[w][1] == best or gain[found[w][1] - 1] == pytest.approx(max(gain))


def test_exchange():
    rng = np.random.default_rng(1)
    kinds = np.array([0] + [1] * 6 + [2] * 6 + [3] * 6)
    flow = np.array([[0, 9, 1, 0], [0, 0, 9, 1], [1, 1, 0, 9], [9, 1, 1, 0]])
    pairs = rng.poisson(flow[kinds][:, kinds] * 5)
    fixed = np.full(19, -1)
    fixed[0] = 0
    found = brown.exchange(pairs, 4, fixed)
    assert found[0] == 0 and 0 not in found[1:]
    assert brown.likelihood(pairs, found, 4) >= brown.likelihood(pairs, kinds, 4) - 1e-6
    for u in range(1, 19):  # no single move is better
        for c in range(1, 4):
            other = found.copy()
            other[u] = c
            assert brown.likelihood(pairs, other, 4) <= brown.likelihood(pairs, found, 4) + 1e-6


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(d, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.lm_scores(one, F.lit(False)).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == pytest.approx(0) and got[2].n_tokens == 1


def test_word_hashes():
    """Equal spans share a hash wherever they lie, others don't; also spans of several eights of bytes, long ones and those at the end of the data."""
    rng = random.Random(7)
    some = [bytes(rng.choice(b"ab") for _ in range(n)) for n in [*range(1, 40), 126, 127, 128, 129, 130, 5000] for _ in range(6)]
    some += [b"\0", b"\0\0", b"\0" * 8, b"\0" * 9, b"\0" * 16]
    seen: dict = {}
    for front in range(9):
        rng.shuffle(some)
        text = np.frombuffer(b" " * front + b" ".join(some), np.uint8)
        lens = np.array([len(x) for x in some])
        ends = front + np.cumsum(lens + 1) - 1
        for x, h in zip(some, words.word_hashes(text, ends - lens, ends).tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(set(some))
    assert len(words.word_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_finder(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.append(rng.integers(0, 2**64, n, np.uint64), np.arange(min(n, 40), dtype=np.uint64)))  # some crowded
    h = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    at, found = words.finder(keys)(h)
    assert found.tolist() == np.isin(h, keys).tolist()
    assert not len(keys) or (keys[at[found]] == h[found]).all() and at.max() < len(keys)


def test_words_beyond_the_head_are_counted_once(spark, monkeypatch):
    """Rounds before the last count words of the head alone, which changes no class."""
    monkeypatch.setattr(lm, "FREQUENT", 6)
    monkeypatch.setattr(lm, "HEAD", 30)
    counted, contexts = [], lm.contexts

    def noted(docs, m, beyond, **how):
        found = contexts(docs, m, beyond, **how)
        if not beyond:
            counted.append({np.uint64(r.word % 2**64) for r in found.select("word").distinct().collect()} - set(m.words) - {np.uint64(lm.GRID)})
        return found

    monkeypatch.setattr(lm, "contexts", noted)
    m, found = trained(spark, corpus())
    assert len(counted) == lm.ROUNDS and not any(counted[:-1]) and len(counted[-1]) == m.distinct - len(m.words) > 0
    monkeypatch.setattr(lm, "contexts", lambda docs, m, beyond, **how: contexts(docs, m, beyond))
    assert trained(spark, corpus())[1] == found


def test_best_classes_of_alike_words(spark, monkeypatch):
    """Words of equal counts share their best class, whatever batch brings them; each is the best by its own gains."""
    monkeypatch.setattr(lm, "HELD", 16 * 500)  # words of several batches are looked at together
    rng = np.random.default_rng(5)
    grid = rng.poisson(30.0, (lm.BEFORE, lm.BEFORE)).astype(float)
    kinds = [{int(s): int(rng.integers(1, 4)) for s in rng.choice(lm.SLOTS, rng.integers(1, 4), replace=False)} for _ in range(90)]
    m = lm.Model(np.arange(10, 20).astype(np.uint64), np.ones(10, np.int64), rng.integers(1, lm.CLASSES, 10), np.zeros(10, bool), 0, 0)
    own = [*(k % 90 for k in range(1300)), *range(90)]
    rows = [(w, s, n) for w, k in enumerate(own) for s, n in kinds[k].items()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.word: r["class"] for r in lm.assigned(spark.createDataFrame(rows, "word long, slot short, n long"), m, grid).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(own)
    for w, k in enumerate(own):
        table = np.zeros((1, lm.SLOTS))
        table[0, list(kinds[k])] = list(kinds[k].values())
        now = int(m.classes[w - 10]) if 10 <= w < 20 else lm.REST
        g = brown.gains(grid, table[:, : lm.BEFORE], table[:, lm.BEFORE : lm.OWN], table[:, lm.OWN], np.array([now]))[0, 1 : lm.CLASSES]
        assert g[got[w] - 1] == pytest.approx(g.max(), rel=2e-6)


def test_gathered():
    import pyarrow as pa

    some = [pa.RecordBatch.from_pydict({"a": list(range(n))}, schema=pa.schema([("a", pa.int64())])) for n in [3, 0, 4, 9, 0, 1, 0]]
    got = [t.column("a").to_pylist() for t in lm._gathered(iter(some), 5)]
    assert got == [[0, 1, 2, 0, 1, 2, 3], list(range(9)), [0]]
    assert not list(lm._gathered(iter(some[1:2]), 5))
