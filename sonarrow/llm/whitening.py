"""Whitening of embeddings by exact integer scatter.

Each entry becomes an integer; tasks subtract a fixed shift and add up sums and cross-products of whole numbers without
rounding, whatever their size; the partial sums meet in an aggregation as digits of base 2**40. The scatter matrix
n·XᵀX - SSᵀ is then formed exactly, and only after that converted to floating point and decomposed. What the driver holds
is one matrix of the vectors' width; it does not grow with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, column, tidy
from .staging import Stage

#: An entry c becomes floor(SCALE * c) + OFFSET; components that are kept at most.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Bits of the limbs in which entries are multiplied, and rows at once: products of limbs then add up below 2**53.
LIMB, ROWS = 20, 4096
#: Bits and number of the digits in which sums are sent: 2**240 is above any sum of products of 64-bit integers.
DIGIT, DIGITS = 40, 6
#: Eigenvalues under this share of the greatest, times the width, are those of a flat direction.
FLAT = 2.0**-50


def finite(vector: Column) -> Column:
    """Not null, and without entries that are null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def _fits(vector: Column, scale: int, offset: int) -> Column:
    """Whether each entry's integer is one of 64 bits, with room for the shift."""
    return ~F.exists(vector, lambda x: F.abs(x.cast("double")) * float(scale) >= 2.0**62 - abs(offset))


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c), without the offset."""
    return np.floor(scale * vectors.astype(np.float64)).astype(np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of limbs times powers of 2**LIMB; all but the last are not negative."""
    out = []
    while True:
        if np.abs(x).max(initial=0) < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB


def cross(x: np.ndarray) -> np.ndarray:
    """xᵀx of integers as Python integers: products of limbs are exact in double precision, their sums are whole numbers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i in range(0, len(x), ROWS):
        limbs = _limbs(x[i : i + ROWS])
        for a, p in enumerate(limbs):
            for b, q in enumerate(limbs):
                total += (p.T @ q).astype(np.int64).astype(object) << (LIMB * (a + b))
    return total


def sums(x: np.ndarray) -> np.ndarray:
    """Column sums of integers as Python integers."""
    low, high = x & ((1 << 32) - 1), x >> 32
    return low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << 32)


def _digits(numbers: list[int]) -> list[pa.Array]:
    """Whole numbers in digits of base 2**DIGIT, the last one with the sign."""
    mask = (1 << DIGIT) - 1
    return [pa.array([(v >> (DIGIT * k)) & mask if k < DIGITS - 1 else v >> (DIGIT * k) for v in numbers], pa.int64()) for k in range(DIGITS)]


def _rows(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def scatter(vectors: DataFrame, *, scale=SCALE, vector_col="embedding") -> tuple[int, int, np.ndarray, np.ndarray]:
    """(width, n, sums, cross-products) of floor(scale * c), exact, over the usable vectors of the commonest width.

    The offset is the shift and so never added. Each task sends, for each width it sees, a row for each pair of dimensions.
    """
    names = [f"d{k}" for k in range(DIGITS)]
    schema = "width int, i int, j int, " + ", ".join(f"{d} long" for d in names)

    def run(batches):
        held: dict[int, list] = {}  # by width: n, sums, cross-products
        for b in batches:
            v = b.column(0)
            lens = v.value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(lens).tolist():
                x = integers(_rows(v.filter(pa.array(lens == w)), w), scale)
                n, s, c = held.get(w, (0, 0, 0))
                held[w] = [n + len(x), s + sums(x), c + cross(x)]
        for w, (n, s, c) in held.items():
            i, j = np.triu_indices(w)
            numbers = [n, *s.tolist(), *c[i, j].tolist()]
            first = np.concatenate([[-1], np.full(w, -1), i])
            second = np.concatenate([[-1], np.arange(w), j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), w, np.int32)), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *_digits(numbers)], names=["width", "i", "j", *names])

    parts = vectors.select(column(vector_col).alias("v")).where(F.size("v") > 0).mapInArrow(tidy(run), schema)
    stage = Stage(vectors.sparkSession, "whitening")
    total = stage.put(parts.groupBy("width", "i", "j").agg(*[F.sum(F.col(d).cast("decimal(38,0)")).alias(d) for d in names]), "total")
    number = lambda r: sum(int(r[d]) << (DIGIT * k) for k, d in enumerate(names))
    commonest = total.where("i = -1 and j = -1").orderBy(*[F.desc(d) for d in reversed(names)], "width").first()
    if commonest is None:
        return 0, 0, np.zeros(0, object), np.zeros((0, 0), object)
    width = commonest["width"]
    rows = total.where((F.col("width") == width) & (F.col("j") >= 0)).collect()  # a row for each dimension, and each pair of two
    stage.drop("total")
    s, c = np.zeros(width, object), np.zeros((width, width), object)
    for r in rows:
        if r["i"] < 0:
            s[r["j"]] = number(r)
        else:
            c[r["i"], r["j"]] = c[r["j"], r["i"]] = number(r)
    return width, number(commonest), s, c


@dataclass
class Model:
    """Width, rows and sums of the fit list (of integers without offset), components as columns, their eigenvalues, the trace."""

    width: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n rounded once, and for each row the exact sum of (n*x - S)**2."""
        top = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if top * top * max(self.width, 1) < 1 << 63:
            y = x * self.n - np.array(self.sums, np.int64)
            return y / self.n, (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return (y / self.n).astype(np.float64), (y * y).sum(axis=1).tolist()

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.eigenvalues)


def decompose(width: int, n: int, s: np.ndarray, c: np.ndarray, components: int = COMPONENTS) -> Model:
    """The scatter matrix n*c - s sᵀ as whole numbers, then its eigenvectors by falling eigenvalue; flat directions are left out."""
    if not n:
        return Model(width, 0, [], np.zeros((width, 0)), np.zeros(0), 0.0)
    exact = c * n - np.outer(s, s)
    v = np.array([[int(x) / (n * n) for x in row] for row in exact], np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = min(components, int((e > e[0] * FLAT * width).sum())) if e[0] > 0 else 0
    return Model(width, n, [int(x) for x in s], np.ascontiguousarray(u[:, :keep]), e[:keep], sum(int(exact[i, i]) for i in range(width)) / (n * n))


def usable(df: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    vector = column(vector_col)
    return df.where(finite(vector)).where(_fits(vector, scale, offset))


def fit(df: DataFrame, *, components=COMPONENTS, scale=SCALE, offset=OFFSET, vector_col="embedding") -> Model:
    """The model of all usable vectors of `df`.

    Left out are vectors that are null, empty, hold a null or non-finite entry or one whose integer has over 62 bits, and
    those of another width than the commonest (of equally common ones the least). Repeated rows count as often as they
    are there. An empty table, and vectors that are all equal, have no component.
    """
    return decompose(*scatter(usable(df, vector_col, scale, offset), scale=scale, vector_col=vector_col), components)


def apply(df: DataFrame, model: Model, *, scale=SCALE, offset=OFFSET, vector_col="embedding", drop: tuple[str, ...] = ()) -> DataFrame:
    """The usable rows of `df` without `drop`, with deviation decimal(38,0) and whitened array<double>, a value a component.

    deviation is the exact sum of (n*x - S)**2 (null if it has more than 38 digits), whitened the projections of x - S/n
    over the square roots of the eigenvalues. Vectors that `fit` leaves out are left out. These columns replace those of
    `df` with their names; other names do not matter.
    """
    good = usable(df, vector_col, scale, offset).where(F.size(column(vector_col)) == model.width) if model.n else df.where("false")
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def f(vectors):
            centred, deviation = m.deviations(integers(_rows(vectors, m.width), scale))
            w = m.whiten(centred)
            k = w.shape[1]
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * k)
            exact = [Decimal(x) if x < 10**38 else None for x in deviation]
            return [pa.array(exact, pa.decimal128(38, 0)), pa.ListArray.from_arrays(at, pa.array(w.ravel()))]

        return f

    return append(good, vector_col, make, "deviation decimal(38,0), whitened array<double>", drop)


def identity_error(df: DataFrame, model: Model, *, scale=SCALE, offset=OFFSET, vector_col="embedding") -> float:
    """The largest absolute entry of the covariance (divisor n) of all whitened rows, minus the identity; 0 without components."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    good = usable(df, vector_col, scale, offset).where(F.size(column(vector_col)) == model.width).select(column(vector_col).alias("v"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        total = np.zeros((k + 1, k))
        for b in batches:
            w = m.whiten(m.deviations(integers(_rows(b.column(0), m.width), scale))[0])  # centred, as x - S/n is
            total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "t"])

    rows = good.mapInArrow(tidy(run), "i int, j int, t double").groupBy("i", "j").agg(F.sum("t").alias("t")).collect()  # (k + 1) * k rows
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r["i"], r["j"]] = r["t"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def by_component(df: DataFrame, model: Model) -> DataFrame:
    """A row for each row of `apply` and component, numbered from 1: component int, whitened double, explained double."""
    share = [float(x) for x in model.eigenvalues / model.trace] if model.trace else []
    explained = F.array(*[F.lit(x) for x in share]) if share else F.array().cast(T.ArrayType(T.DoubleType()))
    pairs = F.arrays_zip(column("whitened").alias("whitened"), explained.alias("explained"))
    rest = [column(c) for c in df.columns if c.lower() not in ("whitened", "component", "explained")]
    d = df.select(*rest, F.posexplode(pairs).alias("_k", "_p"))
    return d.select(*[column(c) for c in d.columns[:-2]], (F.col("_k") + 1).cast("int").alias("component"), F.col("_p.whitened").alias("whitened"), F.col("_p.explained").alias("explained"))
