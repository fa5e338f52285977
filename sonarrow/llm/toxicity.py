"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning in numpy.

A document's features are its words and its words' first 4 and 5 bytes, as 64-bit hashes, each counted once. `fit` draws a
bounded sample of confirmed and of unlabelled documents. Features are counted over the confirmed ones as a Spark job; those
that could be significant are all that the driver sees of the sample. It keeps every feature that confirmed documents have
significantly more often than text at large, and descends the non-negative risk  prior * R+(P) + max(0, R-(U) - prior * R-(P))  of a
linear model with logistic loss. The class prior is the share of toxic ones among labelled training rows. Scores need the
text alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import append, column
from .staging import Stage
from .words import U64, hashes, mix64, prefixes, slices, spans

#: Bounds of the training sample: about so many documents of each kind, and features of each that weights are fitted to.
CONFIRMED, UNLABELLED, DOCUMENT_FEATURES = 4096, 8192, 2048
#: How significant a feature must be, in nats: the Chernoff bound of seeing it so often among as many documents at large.
SIGNIFICANT = 5.5
#: Punctuation and other ASCII that is no part of a word here.
_APART = np.zeros(256, bool)
_APART[:128] = [not chr(c).isalnum() for c in range(128)]


def _features(s):
    """All features of a slice's texts, in order of text, with the text of each."""
    s = s.lower()
    begins, ends, n = spans(s, _APART)
    row = np.repeat(np.arange(s.n), n)
    parts = [hashes(s.data, begins, ends)] + [mix64(prefixes(s.data, begins, ends, k) + U64(k)) for k in (4, 5)]
    return np.concatenate(parts), np.tile(row, len(parts))


class Model:
    """Weights of the kept features, in order of their hashes, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, float(bias)

    def scores(self, texts) -> np.ndarray:
        out = [np.zeros(0)]
        seen = np.zeros(1 << 16, bool)
        seen[self.keys >> U64(48)] = True
        before: list[np.ndarray] = []  # features of the parts of a long text
        for s in slices(texts, parts=True):
            row, at = self._known(s, seen)
            if s.more or before:
                before.append(at)
                if s.more:
                    continue
                at, before = np.unique(np.concatenate(before)), []
                row = np.zeros(len(at), np.int64)
            total = self.bias + np.bincount(row, self.weights[at], s.n)
            out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
        return np.concatenate(out)

    def _known(self, s, seen) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, feature of the model) pairs of a slice."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, row = _features(s)
        ok = seen[h >> U64(48)]
        h, row = h[ok], row[ok]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ok = self.keys[at] == h
        pair = np.unique(row[ok] * np.int64(len(self.keys)) + at[ok])
        return pair // len(self.keys), pair % len(self.keys)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """The non-negative risk of the outputs `z`, and its unlabelled part before it is cut off at zero."""
    soft = lambda x: np.logaddexp(0, x).mean()  # noqa: E731  the logistic loss of outputs of the wrong sign
    rest = soft(z[~positive]) - prior * soft(z[positive])
    return prior * soft(-z[positive]) + max(0.0, rest), rest


def slope(z: np.ndarray, positive: np.ndarray, prior: float, rest: float) -> np.ndarray:
    """Which way to descend: the risk's gradient by `z`, or, below zero, that which brings the unlabelled part back up."""
    up, n_p, n_u = _sigmoid(z), positive.sum(), (~positive).sum()
    if rest >= 0:
        return np.where(positive, prior * (up - 1) / n_p - prior * up / n_p, up / n_u)
    return np.where(positive, prior * up / n_p, -up / n_u)


def least_count(n_p: int, n_u: int) -> int:
    """How often, of n_p confirmed documents, a feature must be seen that no unlabelled document has, to be significant."""
    expected, count = n_p / (n_u + 2), 1
    while count <= n_p and (count <= expected or expected - count + count * math.log(count / expected) < SIGNIFICANT):
        count += 1
    return count


def significant(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """The features that confirmed documents have significantly more often than unlabelled ones, ascending."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    keys, count = np.unique(np.concatenate([x for x, p in zip(rows, positive, strict=True) if p]), return_counts=True)
    count_u = np.zeros(len(keys), np.int64)
    for x in (x for x, p in zip(rows, positive, strict=True) if not p and len(keys)):  # each feature once a document
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        count_u[at[keys[at] == x]] += 1
    expected = n_p * (count_u + 1) / (n_u + 2)
    nats = np.where(count > expected, expected - count + count * np.log(count / expected), 0.0)
    return keys[nats >= SIGNIFICANT]


def nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Fit on documents' feature hashes; `positive` marks the confirmed ones, the others are unlabelled."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not 0 < prior < 1:
        return Model(np.zeros(0, U64), np.zeros(0), np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)) if 0 < prior < 1 else -30.0 if prior <= 0 else 30.0)
    keys = significant(rows, positive)
    if not len(keys):
        return Model(keys, np.zeros(0), np.log(prior / (1 - prior)))
    table = []
    for x in rows:
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        table.append(at[keys[at] == x])
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in table])
    feature = np.concatenate(table)
    w, b = np.zeros(len(keys)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    least, best = np.inf, (w, b)
    for step in range(1, steps + 1):
        z = b + np.bincount(doc, w[feature], len(rows))
        total, rest = risk(z, positive, prior)
        total += decay / 2 * (w @ w)
        if total < least:  # steps that climb back may overshoot, so the best point on the way is the result
            least, best = total, (w, b)
        by_doc = slope(z, positive, prior, rest)
        g = np.append(np.bincount(feature, by_doc[doc], len(keys)) + decay * w, by_doc.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return Model(keys, *best)


def _distinct(texts) -> pa.Array:
    """The distinct features of each text, ascending as signed numbers."""
    out, before = [], []
    for s in slices(texts, parts=True):
        h, row = _features(s)
        h = h.view(np.int64)
        if s.more or before:
            before.append(np.unique(h))
            if not s.more:
                out.append(np.unique(np.concatenate(before)))
                before = []
            continue
        order = np.argsort(row, kind="stable")
        h, cut = h[order], np.searchsorted(row[order], np.arange(s.n + 1))
        out += [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    at = np.cumsum([0, *map(len, out)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))


def _kept(lists: pa.Array, keys: np.ndarray, most: int) -> list[bytes]:
    """Of each list those that are among the ascending `keys`, at most the `most` least."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    found = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
    ok = keys[found] == flat if len(keys) else np.zeros(len(flat), bool)
    return [flat[a:b][ok[a:b]][:most].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _drawn(id_col, n: int, most: int, seed: int):
    """A draw of about `most` of `n` rows that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col="doc_id",
    text_col="text",
    label_col="toxic",
    train: Column | None = None,
    confirmed=CONFIRMED,
    unlabelled=UNLABELLED,
    document_features=DOCUMENT_FEATURES,
) -> Model:
    """Learn from rows for which `train` (a condition on the id column) holds; null labels and unmatched ids are ignored.

    The sample is about `confirmed` toxic and `unlabelled` other documents, drawn by a hash of the id. Of a document with
    more than `document_features` features that could be significant, those of least hash are learned from; no document
    keeps another one out. An id with several labels counts as toxic if one says so. Rows of equal id are documents of
    their own. Without confirmed or without unlabelled training text, or with empty tables, the model is the prior alone.
    """
    train = F.lit(True) if train is None else train
    known = labels.where(train & column(id_col).isNotNull() & column(label_col).isNotNull()).groupBy(column(id_col).alias("_id")).agg(F.max(column(label_col)).alias("_y"))
    n, n_p = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("_y") == 1, 1)), F.lit(0))).first()
    pool = docs.where(train).select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    chosen = known.where((F.col("_y") == 1) & _drawn(F.col("_id"), n_p, confirmed, 1)).select("_id", F.lit(True).alias("_p"))
    # about `confirmed` ids at most
    pool = pool.join(F.broadcast(chosen), "_id", "left").withColumn("_u", F.coalesce(_drawn(F.col("_id"), pool.count(), unlabelled, 2), F.lit(False)))
    pool = pool.where(F.col("_p") | F.col("_u")).select(F.xxhash64(F.lit(4), "_id", "_text").alias("_at"), F.coalesce("_p", F.lit(False)).alias("_p"), "_u", "_text")
    stage = Stage(docs.sparkSession, "toxicity")
    sample = stage.put(append(pool, "_text", lambda: lambda texts: [_distinct(texts)], "h array<long>", drop=("_text",)), "sample")
    sizes = sample.agg(F.coalesce(F.sum(F.col("_p").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("_u").cast("int")), F.lit(0))).first()
    often = sample.where("_p").select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= least_count(*sizes))
    keys = np.sort(np.array(stage.put(often.select("h"), "often").toArrow().column("h"), np.int64))  # a share of the features of `confirmed` documents
    held = docs.sparkSession.sparkContext.broadcast(keys)
    most = document_features
    # the unlabelled draw is of all text, confirmed documents among it included
    kinds = F.filter(F.array(F.when(F.col("_p"), True), F.when(F.col("_u"), False)), lambda x: x.isNotNull())
    got = append(sample, "h", lambda: lambda lists: [pa.array(_kept(lists, held.value, most), pa.binary())], "kept binary", drop=("h",))
    got = got.select(F.explode(kinds).alias("positive"), "_at", "kept").toArrow()
    stage.drop("sample", "often")
    order = sorted(range(len(got)), key=list(zip(got.column("positive").to_pylist(), got.column("_at").to_pylist(), strict=True)).__getitem__)
    rows = [np.sort(np.frombuffer(got.column("kept")[i].as_buffer(), U64)) for i in order]
    return nnpu(rows, np.array(got.column("positive").to_pylist(), bool)[order], n_p / n if n else 0.0)


def score(docs: DataFrame, model: Model, *, text_col="text", out="score", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without `drop`, with a score from 0 to 1 of each whole text; null and empty texts get the model's prior score.

    Equal texts get equal scores, and an empty table gives an empty one. `out` replaces a column of `docs` with its name;
    other names do not matter. Long texts are read in parts.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def make():
        m = Model(*held.value)
        return lambda texts: [pa.array(m.scores(texts), pa.float64())]

    return append(docs, text_col, make, f"`{out}` double", drop)
