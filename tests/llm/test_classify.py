"""Toxicity and language models: held-out accuracy, and every odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarrow.llm import langid, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string"
SYLLABLES = {"en": "th ing er on the of", "de": "sch ung ein ch der ü", "fr": "eau ou que é la ç"}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        w = [word(rng, lang) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "Scum!", "vilex" + word(rng, lang)]))
        docs.append((i, " ".join(w), lang, "s", None))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "12 !!", "de"), (2003, "a", None), (2004, "the of " * 20000, "en"), (None, "sch ung", "de"), (3, "twin", "fr")]
    docs += [(i, t, lang, None, "x") for i, t, lang in odd]
    labels += [(2000, 1, None), (None, 1, 1), (5000, 0, 1), (0, 1, 1), (0, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: any(x in t for x in ("moron", "Scum", "vilex")) for i, t, *_ in docs if t}


def test_toxicity(spark, corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(docs, labels, train=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    got = toxicity.score(docs, model, out="toxic").collect()
    assert len(got) == docs.count() and all(0 <= r.toxic <= 1 for r in got)
    right = [(r.toxic >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id is not None and 0 < r.doc_id < 900 and r.text != "twin"]
    assert np.mean(right) > 0.98
    prior = {round(r.toxic, 12) for r in got if not r.text}
    assert len(prior) == 1 and prior.pop() < 0.5


def test_toxicity_without_examples(spark, corpus):
    docs, labels, _ = corpus
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score2 for r in toxicity.score(docs, none, out="score2").collect()} == {1 / (1 + np.exp(30.0))}
    empty = docs.where("doc_id = -1")
    assert toxicity.score(empty, toxicity.fit(empty, labels.where("doc_id = -1")), out="s").count() == 0


def test_risk_is_corrected():
    """Unlabelled text that holds a third of toxic documents does not teach that their words are harmless."""
    rng = np.random.default_rng(0)
    common = lambda: rng.choice(np.arange(100, 400), 40, replace=False)
    toxic = lambda: np.unique(np.append(common(), rng.choice(np.arange(5), 2))).astype(np.uint64)
    clean = lambda: np.unique(common()).astype(np.uint64)
    p, u = [toxic() for _ in range(200)], [toxic() if k % 3 == 0 else clean() for k in range(600)]
    m = toxicity.nnpu(p + u, np.arange(800) < 200, 1 / 3)
    z = [m.bias + m.weights[np.isin(m.keys, x)].sum() for x in u]
    assert np.mean([(v > 0) == (k % 3 == 0) for k, v in enumerate(z)]) > 0.97


def test_languages(spark, corpus):
    docs, _, _ = corpus
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = langid.fit(docs, train_if=~held)
    got = langid.predict(docs, model).withColumn("held", F.coalesce(held, F.lit(False))).collect()
    assert len(got) == docs.count()
    real = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.text != "twin"]
    assert np.mean([r.lang_pred == r.lang for r in real if r.held]) > 0.98
    assert np.mean([r.rejected for r in real]) < 0.01
    for r in got:
        if r.doc_id in (2000, 2001, 2002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in SYLLABLES and 0 < r.score <= 1


def test_no_languages(spark, corpus):
    docs = corpus[0]
    assert langid.fit(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id < 50"), one).collect()} == {"en"}
    assert langid.predict(docs.where("doc_id = -1"), one).count() == 0


def test_risk_and_gradient():
    """The risk against its definition, and the gradient against differences of it."""
    rng = np.random.default_rng(3)
    for prior, shift in ((0.3, 0.0), (0.7, -4.0)):
        z, positive = rng.normal(shift, 2, 40), np.arange(40) < 15
        loss = lambda x: np.log(1 + np.exp(-x))
        plus = sum(loss(x) for x in z[positive]) / 15
        minus_u, minus_p = sum(loss(-x) for x in z[~positive]) / 25, sum(loss(-x) for x in z[positive]) / 15
        rest = minus_u - prior * minus_p
        got = toxicity.risk(z, positive, prior)
        assert got == pytest.approx((prior * plus + max(0, rest), rest))
        assert (rest < 0) == (prior == 0.7) or rest >= 0
        slope = toxicity.slope(z, positive, prior, rest)
        part = (lambda v: toxicity.risk(v, positive, prior)[0]) if rest >= 0 else (lambda v: -toxicity.risk(v, positive, prior)[1])
        for i in range(40):
            d = np.zeros(40)
            d[i] = 1e-5
            assert slope[i] == pytest.approx((part(z + d) - part(z - d)) / 2e-5, abs=1e-8)


def test_calibration():
    """The threshold against its definition, on documents that are one bucket each."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 9000)
    bucket = np.where(rng.random(9000) < 0.1, 2, y)  # a tenth says nothing
    docs = [(np.array([b], np.uint16), np.ones(1, np.float32)) for b in bucket]
    m = langid.train(docs, y, ["a", "b"])
    z = (m.table[bucket[2::3]] + m.bias) / m.temperature
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == y[2::3]])
    at = 0.001 * (len(right) + 1)  # between the guess and the ordered values, by the same line at every size
    line = [0.5, *right]
    assert m.threshold == pytest.approx(line[int(at)] + (at % 1) * (line[int(at) + 1] - line[int(at)]))
    few = langid.train(docs[:30], y[:30], ["a", "b"])
    assert 0.5 < few.threshold < 0.51


def test_clashing_columns_and_long_texts(spark):
    """Computed columns take the place of those of the same name, whatever the others are called; long texts come in parts."""
    long = "sch ung " * 300_000
    rows = [(1, "th er ing", "en", 7, 7, 7, 7, 7, 7), (2, long + "moron", "de", 7, 7, 7, 7, 7, 7), (3, None, "de", 7, 7, 7, 7, 7, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score int, rejected int, lang_pred int, _source int, _text int, `a.b` int")
    few = [(10 + i, " ".join(random.Random(i).choices(SYLLABLES["de"].split(), k=60)) + (" moron" if i % 6 == 0 else ""), "en" if i % 2 else "de") for i in range(120)]
    docs = spark.createDataFrame(few, "doc_id long, text string, lang string")
    tox = toxicity.fit(docs, spark.createDataFrame([(10 + i, int(i % 6 == 0)) for i in range(120)], "doc_id long, toxic int"))
    got = toxicity.score(d, tox, out="_text")
    assert got.columns == ["doc_id", "text", "lang", "Score", "rejected", "lang_pred", "_source", "a.b", "_text"]
    s = {r.doc_id: r["_text"] for r in got.collect()}
    assert s[2] > 0.5 > s[1] and s[3] == pytest.approx(1 / (1 + np.exp(-tox.bias)))
    model = langid.fit(docs)
    found = langid.predict(d, model)
    assert found.columns == ["doc_id", "text", "lang", "_source", "_text", "a.b", "lang_pred", "score", "rejected"]
    whole = {r.doc_id: r for r in found.collect()}
    short = langid.predict(spark.createDataFrame([(1, "sch ung " * 3000)], "i int, text string"), model).first()
    assert whole[2].lang_pred == short.lang_pred and whole[2].score == pytest.approx(short.score, abs=1e-3)
    assert whole[3].rejected and langid.predict(d, None).where("rejected").count() == 3


def test_parts_of_long_texts_make_the_whole():
    import pyarrow as pa

    from sonarrow.llm.words import Slice, slices

    text = "".join(random.Random(1).choices("abc de\u00e9\n", k=1_500_000))
    texts = pa.array(["x", text, None, "y" * 1_200_000, "z"])
    parts = [(s.first, s.more, s.data.tobytes()) for s in slices(texts, parts=True)]
    assert len(parts) > 5 and all(p.endswith((b" ", b"\n")) for _, more, p in parts if more)
    assert b"".join(p for _, _, p in parts) == "".join(t or "" for t in texts.to_pylist()).encode()
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, n = langid._subwords(Slice(data, np.array([0, len(data)]), 0))
    pieces = list(langid._pieces(Slice(data, np.array([0, len(data)]), 0)))
    assert len(pieces) > 1
    for k in range(2):
        assert (np.concatenate([b[k] for b, _ in pieces]) == bucket[k]).all() and sum(m[k].sum() for _, m in pieces) == n[k].sum()


def test_subwords_stay_in_texts():
    import pyarrow as pa

    from sonarrow.llm.words import slices

    texts = ["abcdefg", "", "x", "abcdefg", "ab", "abc"]
    (s,) = slices(pa.array(texts))
    bucket, n = langid._subwords(s)
    assert [x.tolist() for x in n] == [[5, 0, 0, 5, 0, 1], [3, 0, 0, 3, 0, 0]]
    assert all(len(b) == k.sum() for b, k in zip(bucket, n, strict=True))
    assert bucket[0][:5].tolist() == bucket[0][5:10].tolist() and bucket[0][10] == bucket[0][0]


def test_a_long_text_keeps_no_other_out(spark):
    """A text of very many features, first in both draws, leaves sample and result as they are without it."""
    rng = random.Random(6)
    rows = [(i, " ".join(word(rng, "en") for _ in range(60)) + (" moron scum" if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(-1, 1)], "doc_id long, toxic int")
    long = (-1, " ".join(f"w{k}x" for k in range(90_000)), "de")
    docs = spark.createDataFrame([*rows, long], "doc_id long, text string, lang string").repartition(3)
    model = toxicity.fit(docs, labels, confirmed=500, unlabelled=500, document_features=64)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect() if r.doc_id >= 0}
    assert len(model.keys) > 2 and got == {i: i % 5 == 0 for i in range(400)}
    m = langid.fit(docs, sample_bytes=400_000, document_subwords=256)
    assert m.languages == ["de", "en"]
    assert langid.fit(docs, sample_bytes=1).languages == ["de", "en"]  # one document of each at least


def test_a_thousand_languages(spark):
    rows = [(3 * k + i, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 30 + str(i), f"l{k:04}") for k in range(1000) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 1000 and model.weights.shape == (langid.WIDTH, 1000)
    got = langid.predict(docs.where("doc_id < 30"), model)
    assert got.count() == 30 and {r.lang_pred for r in got.collect()} <= set(model.languages)


def test_two_languages_are_calibrated(spark, corpus):
    model = langid.fit(corpus[0].where("lang in ('en', 'de')"))
    assert model.threshold > 0.5 and model.languages == ["de", "en"]


def test_features_that_could_be_significant():
    for n_p, n_u in ((5, 9), (300, 40), (4096, 8192), (1, 0), (0, 0)):
        k = toxicity.least_count(n_p, n_u)
        rows = [np.array([7], np.uint64)] * k + [np.zeros(0, np.uint64)] * (n_p - k + n_u)
        if k <= n_p:
            positive = np.arange(n_p + n_u) < n_p
            assert toxicity.significant(rows, positive).tolist() == [7]
            assert k == 1 or toxicity.significant(rows[1:k] + rows[k:] + [np.zeros(0, np.uint64)], np.arange(n_p + n_u) < n_p).tolist() == []


def test_kept_features():
    import pyarrow as pa

    lists = pa.array([[-5, 1, 3, 9], [], [3]], pa.list_(pa.int64()))
    kept = lambda keys, most: [np.frombuffer(b, np.int64).tolist() for b in toxicity._kept(lists, np.array(keys, np.int64), most)]
    assert kept([-5, 3, 9], 2) == [[-5, 3], [], [3]] and kept([], 5) == [[], [], []] and kept([100], 5) == [[], [], []]
