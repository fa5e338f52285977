"""The Jaccard join against all pairs."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from sonarrow.llm import jaccard
from sonarrow.llm.partition import Signer
from sonarrow.llm.words import U64


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def roots(sets, similarity):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= similarity:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    texts = [None, "", "  ", "one", "One", "one two", "one two three"]
    for n in (3, 5, 9, 11, 14, 20, 35, 80, 300):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(6):
                w = list(base)
                for _ in range(rng.randrange(0, max(2, n // 25))):
                    i = rng.randrange(len(w))
                    w[i : i + 1] = rng.choice([[], [word()], [w[i], word()]])
                texts.append(" ".join(w))
    chain = [word() for _ in range(90)]  # a chain whose ends are far apart
    for i in range(20):
        chain[i * 4] = word()
        texts.append(" ".join(chain))
    texts += [texts[10]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("shingle,similarity", [(3, (90, 100)), (5, (80, 100))])
def test_against_all_pairs(spark, shingle, similarity):
    texts = corpus()
    ids = [i * 3 % 1000 for i in range(len(texts))]
    ids[5] = ids[6]  # a repeated id
    ids[9] = None
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, set_id int, root string")
    sets = shingle_sets(texts, shingle)
    r = roots(sets, Fraction(*similarity))
    want = []
    for i, t in enumerate(texts):
        own = [ids[j] for j in range(len(texts)) if r[j] == r[i] and ids[j] is not None]
        want.append((str(ids[i]), len(sets[i]), str(ids[i] if not sets[i] else min(own, default=None))))
    got = [(str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.join_components(d, shingle=shingle, similarity=similarity).collect()]
    assert sorted(got) == sorted(want)

    kept = jaccard.one_of_each(d, shingle=shingle, similarity=similarity)
    assert kept.columns == d.columns
    rows = kept.collect()
    assert len(rows) == len(set(r))
    kept_sets = shingle_sets([x.text for x in rows], shingle)
    full = [s for s in kept_sets if s]
    assert len(set(roots(full, Fraction(*similarity)))) == len(full)


@pytest.mark.parametrize("crowd", [0, 1000])
def test_crowds(spark, monkeypatch, crowd):
    """Groups beyond the pair limit, in several blocks, give the same."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = shingle_sets(texts, 3)
    r = roots(sets, Fraction(9, 10))
    least = {k: min(j for j in range(60) if r[j] == k) for k in set(r)}
    assert {x.doc_id: x.component_id for x in jaccard.join_components(d).collect()} == {i: least[r[i]] for i in range(60)}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_components(d).count() == 0 and jaccard.one_of_each(d).count() == 0
    one = spark.createDataFrame([(1, None), (2, None), (3, "a")], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.join_components(one).collect()} == {1: 1, 2: 2, 3: 3}
    assert jaccard.one_of_each(one).count() == 3


@pytest.mark.parametrize("num", [80, 90])
def test_signatures_miss_nothing(num):
    rng, sign, similar = np.random.default_rng(num), Signer(num, 100), 0
    for _ in range(4000):
        n = int(rng.integers(1, 130))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(U64) * U64(2))
        gone = int(rng.integers(0, n // 4 + 1))
        y = np.unique(np.append(np.delete(x, rng.choice(n, min(gone, n - 1), replace=False)), rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(U64) * U64(2) + U64(1)))
        both = len(np.intersect1d(x, y))
        if 100 * both >= num * (len(x) + len(y) - both) and (len(x) != len(y) or (x != y).any()):
            similar += 1
            assert len(np.intersect1d(sign(x), sign(y)))
    assert similar > 500


def test_clashing_columns_and_long_texts(spark):
    """Names used inside do not matter, and a text of several parts has the shingles of the whole."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(330_000))
    rows = [(1, long, 7, 7, 7, 7, 7), (2, long + " tail", 7, 7, 7, 7, 7), (3, "a b c d e f", 7, 7, 7, 7, 7), (3, "a b c d e f", 7, 7, 7, 7, 7), (None, None, 7, 7, 7, 7, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, stays int, Row int, hash int, _id int, id int")
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    n = len(shingle_sets([long], 3)[0])
    assert {r.n_shingles for r in jaccard.join_components(d.where("doc_id < 3")).collect()} == {n, n + 1}


def test_families_of_templates(spark):
    """Near-template texts whose similarity lies under the bound: nothing links, and few pairs are sent whole."""
    rng = random.Random(6)
    base = [f"t{i}" for i in range(300)]
    pairs = {}
    for n in (60, 120):
        texts = []
        for k in range(n):
            w = list(base)
            for i in rng.sample(range(0, 300, 6), 15):
                w[i] = f"u{k}x{i}"
            texts.append(" ".join(w))
        stats: dict = {}
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = jaccard.join_components(d, stats=stats).collect()
        sets = shingle_sets(texts, 3)
        r = roots(sets, Fraction(9, 10))
        least = {k: min(j for j in range(n) if r[j] == k) for k in set(r)}
        assert {x.doc_id: x.component_id for x in got} == {i: least[r[i]] for i in range(n)}
        pairs[n] = stats["untested"] + stats["pairs"] + stats["second"]
    assert pairs[120] <= 2**1.3 * max(pairs[60], 1) + 100
