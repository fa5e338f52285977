"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are the runs of 3 and of 5 bytes of the lower-cased text, hashed into `BUCKETS` buckets. A text's vector is the
average of its subwords' embeddings. Training sees a bounded sample of labelled documents, drawn by a hash of the id; a
third of them sets the softmax temperature and the confidence under which a prediction is rejected. As average and softmax
input are linear, scoring adds up rows of the product of embeddings and output weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import append, column
from .staging import Stage
from .words import SLICE_BYTES, U64, Slice, slices

BITS = 16
BUCKETS = 1 << BITS
#: Bounds of the training sample: about so many documents of each language, bytes of subword counts of all (and at least
#: one document of each), and distinct subwords of a document, the most frequent ones.
PER_LANGUAGE, SAMPLE_BYTES, DOCUMENT_SUBWORDS = 1024, 32 << 20, 4096
#: The embeddings' width; passes of SGD; every how many documents one is set apart.
WIDTH, PASSES, APART = 16, 6, 3
#: The share of right predictions, on texts set apart, that calibrated rejection may cost.
REJECTED = 0.001
UNKNOWN = "und"
_SPAN = (3, 5)


def _subwords(s):
    """The bucket of each subword of a slice and how many each text has; a text of under 3 bytes has none."""
    data, at = s.lower().data.astype(U64), s.at
    bucket, row = [], []
    code = data.copy()
    for k in range(1, max(_SPAN)):
        code = code[: max(0, len(data) - k)] | (data[k:] << U64(8 * k))
        if k + 1 in _SPAN:
            n = np.maximum(np.diff(at) - k, 0)
            inside = np.ones(len(code), bool)
            for j in range(k):  # runs that go over a text's end
                e = at[1:-1] - 1 - j
                inside[e[(e >= 0) & (e < len(code))]] = False
            h = (code + U64(k)) * U64(0x9E3779B97F4A7C15)
            bucket.append((h >> U64(64 - BITS)).astype(np.int32)[inside])
            row.append(n)
    return bucket, row


def _sum_rows(table: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), table.shape[1]))
    full = np.flatnonzero(n)
    if len(full):
        first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for c in range(table.shape[1]):
            out[full, c] = np.add.reduceat(table[:, c][bucket], first)
    return out


def _pieces(s: Slice):
    """The subwords of a slice; those of a text longer than a slice come range by range, by where they begin."""
    if s.n > 1 or len(s.data) <= SLICE_BYTES:
        yield _subwords(s)
        return
    for a in range(0, len(s.data), SLICE_BYTES):
        data = s.data[a : a + SLICE_BYTES + max(_SPAN) - 1]
        bucket, _ = _subwords(Slice(data, np.array([0, len(data)]), s.first))
        bucket = [x[:SLICE_BYTES] for x in bucket]
        yield bucket, [np.array([len(x)]) for x in bucket]


class Model:
    """`languages` in order, the softmax, and the rejection threshold.

    `table` has a row for each bucket: of softmax inputs, or, where languages are more than embeddings are wide, of
    embeddings, which `weights` then takes to the inputs.
    """

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0, weights: np.ndarray | None = None):
        self.languages, self.table, self.bias, self.temperature, self.threshold, self.weights = languages, table, bias, temperature, threshold, weights

    def inputs(self, average: np.ndarray) -> np.ndarray:
        return (average if self.weights is None else average @ self.weights) + self.bias

    def probabilities(self, texts) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for s in slices(texts):
            z, n = 0.0, 0
            for bucket, k in _pieces(s):
                z = z + sum(_sum_rows(self.table, b, m) for b, m in zip(bucket, k, strict=True))
                n = n + sum(k)
            out.append(_softmax(self.inputs(z / np.maximum(n, 1)[:, None]) / self.temperature))
        return np.concatenate(out)


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """SGD over documents given as (distinct buckets, shares); every third of each language is set apart for calibration.

    The threshold is the quantile REJECTED of the confidence of right predictions among those set apart, on the line
    through their ordered values, which begins at a guess's confidence.
    """
    rng, n, k = np.random.default_rng(seed), len(docs), len(languages)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    w[:] = rng.normal(0, 0.1, w.shape)
    nth, seen = np.zeros(n, np.int64), np.zeros(k, np.int64)
    for i, y in enumerate(labels):
        nth[i] = seen[y]
        seen[y] += 1
    apart = nth % APART == APART - 1
    use = np.flatnonzero(~apart)
    at = 0
    for _ in range(PASSES):
        for i in rng.permutation(use):
            idx, c = docs[i]
            if not len(idx):
                continue
            rate = 1.0 * (1 - at / (PASSES * len(use))) + 0.01
            at += 1
            x = c @ e[idx]
            p = np.exp((z := x @ w + b) - z.max())
            g = p / p.sum()
            g[labels[i]] -= 1
            step = w @ g
            w -= rate * np.outer(x, g)
            b -= rate * 0.1 * g
            e[idx] -= (rate * min(10, 1 / (c @ c)) * c)[:, None] * step  # a text of few subwords moves them no further than itself
    e, w = e.astype(np.float64), w.astype(np.float64)
    model = Model(languages, e @ w if k <= WIDTH else e, b.astype(np.float64), weights=None if k <= WIDTH else w)
    model.threshold = 1 / k
    check = [i for i in np.flatnonzero(apart) if len(docs[i][0])]
    if check and k > 1:
        z = model.inputs(np.array([docs[i][1] @ model.table[docs[i][0]] for i in check]))
        y = labels[check]
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        model.threshold = float(np.interp(REJECTED * (len(right) + 1), np.arange(len(right) + 1), [1 / k, *right]))
    return model


def _counted(texts, most: int) -> tuple[list[bytes], list[bytes]]:
    """The `most` most frequent distinct buckets of each text, ascending, and the share that each has of their subwords."""
    idx, share = [], []

    def put(buckets, counts=None):
        u, inverse = np.unique(buckets, return_inverse=True)
        c = np.bincount(inverse, counts, len(u))
        return u, c

    for s in slices(texts):
        if s.n == 1:
            u, c = np.zeros(0, np.int64), np.zeros(0)
            for bucket, _ in _pieces(s):
                x, k = put(np.concatenate(bucket))
                u, c = put(np.concatenate([u, x]), np.concatenate([c, k]))
            found = [(u, c)]
        else:
            bucket, n = _subwords(s)
            cuts = [np.concatenate([[0], np.cumsum(x)]) for x in n]
            found = [put(np.concatenate([b[q[i] : q[i + 1]] for b, q in zip(bucket, cuts, strict=True)])) for i in range(s.n)]
        for u, c in found:
            if len(u) > most:
                top = np.sort(np.lexsort((u, -c))[:most])
                u, c = u[top], c[top]
            idx.append(u.astype(np.uint16).tobytes())
            share.append((c / max(c.sum(), 1)).astype(np.float32).tobytes())
    return idx, share


def fit(
    docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", train_if=None, per_language=PER_LANGUAGE, sample_bytes=SAMPLE_BYTES, document_subwords=DOCUMENT_SUBWORDS
) -> Model | None:
    """Learn from rows for which `train_if` holds and whose text and language are not null; None if there are none.

    The sample is about `per_language` documents of each language, drawn by a hash of the id; of each language it goes on
    in order of that draw until its part of `sample_bytes` is full, so that each has a document at least. A document
    counts by its `document_subwords` most frequent subwords. Repeated rows are drawn together. The driver holds a row for
    each language besides the sample.
    """
    train_if = F.lit(True) if train_if is None else train_if
    pool = docs.where(train_if & column(text_col).isNotNull() & column(lang_col).isNotNull())
    pool = pool.select(column(lang_col).alias("lang"), column(text_col).alias("text"), F.coalesce(F.pmod(F.xxhash64(F.lit(3), column(id_col)), F.lit(1 << 30)), F.lit(0)).alias("draw"))
    stage = Stage(docs.sparkSession, "langid")
    # the least draw of a language is in the sample, whatever its share
    counts = stage.put(pool.groupBy("lang").agg(F.count("*").alias("rows"), F.min("draw").alias("least")), "counts")
    n = counts.count()
    if not n:
        return None
    limits = counts.select("lang", F.greatest(F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("rows")) * (1 << 30), F.col("least") + 1).alias("limit"))
    sample = pool.join(limits, "lang").where(F.col("draw") < F.col("limit")).drop("limit")

    def make():
        return lambda texts: [pa.array(x, pa.binary()) for x in _counted(texts, document_subwords)]

    sample = stage.put(append(sample, "text", make, "idx binary, share binary", drop=("text",)), "sample")
    # rows of equal draw stay or go together
    size = F.length("idx") + F.length("share")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("lang").orderBy("draw").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = sample.withColumn("before", before).where(F.col("before") < max(1, sample_bytes // n)).select("lang", "draw", "idx", "share").toArrow()
    stage.drop("sample", "counts")
    languages = sorted(set(got.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    rows = [(np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(c.as_buffer(), np.float32)) for a, c in zip(got.column("idx"), got.column("share"), strict=True)]
    drawn, lang = got.column("draw").to_pylist(), got.column("lang").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (drawn[i], lang[i], rows[i][0].tobytes()))
    return train([rows[i] for i in order], np.array([number[lang[i]] for i in order], int), languages)


def predict(docs: DataFrame, model: Model | None, *, text_col="text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without `drop`, with lang_pred, score (its probability) and rejected.

    A null text and one without a letter get `und`, score 0 and are rejected, as does every text if there is no model. A
    text of under 3 bytes is scored by the bias alone. Equal texts get equal values, and an empty table gives an empty
    one. These columns replace those of `docs` with their names; other names do not matter. Subwords of long texts are
    counted range by range.
    """
    columns = "lang_pred string, score double, rejected boolean"
    if model is None:
        return append(docs, text_col, lambda: lambda t: [pa.array([UNKNOWN] * len(t), pa.string()), pa.array(np.zeros(len(t))), pa.array(np.ones(len(t), bool))], columns, drop)
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.threshold, model.weights))

    def make():
        m = Model(*held.value)
        names = pa.array([*m.languages, UNKNOWN], pa.string())

        def f(texts, letter):
            p = m.probabilities(texts)
            blank = ~letter.to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(blank, len(m.languages), p.argmax(axis=1)) if len(p) else np.zeros(0, np.int64)
            score = np.where(blank, 0.0, p.max(axis=1)) if len(p) else np.zeros(0)
            return [names.take(pa.array(best)), pa.array(score), pa.array(blank | (score < m.threshold))]

        return f

    return append(docs, text_col, make, columns, drop, beside=F.coalesce(column(text_col).rlike(r"\p{L}"), F.lit(False)))
