"""Matrices as rows of arrays, or as coordinates (r, c, v), and quantized blocks of 32."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 32
#: Entries of a weight matrix that each executor may hold whole.
HELD = 1 << 24


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, where an expression would repeat it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinates (r, k, v) times (k, c, v): an equality join on k and one aggregation; zeros are left out before."""
    p = a.where("v != 0").select("r", "k", F.col("v").alias("_a")).join(b.select("k", "c", F.col("v").alias("_b")), "k")
    return p.groupBy("r", "c").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


#: Entries of a weight matrix that each executor may hold whole.
HELD = 1 << 24


def linear(rows: DataFrame, keys: list[str], x: str, weights: DataFrame, bias: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """(keys, y): each row's array x times the transpose of a weight table (out, pos, w), plus a bias table (out, b).

    Up to `held` entries each executor gets the matrix once, and batches of rows are multiplied by it; a larger one is
    joined by place, and the products are added up by key and output. Places of the matrix without an entry, outputs
    without a bias and places beyond an array's end count as 0. `keys` tell rows apart; a null array gives null.
    """
    n_out, width = weights.agg(F.coalesce(F.max("out") + 1, F.lit(0)), F.coalesce(F.max("pos") + 1, F.lit(0))).first()
    if n_out * width > held:
        return _linear_joined(rows, keys, x, weights, bias)
    m, b = np.zeros((width, n_out)), np.zeros(n_out)
    t = weights.select("out", "pos", "w").toArrow()  # `held` entries at most
    np.add.at(m, (np.array(t.column("pos")), np.array(t.column("out"))), np.array(t.column("w"), float))
    if bias is not None:
        t = bias.where(F.col("out") < n_out).select("out", "b").toArrow()
        np.add.at(b, np.array(t.column("out")), np.array(t.column("b"), float))
    matrix = rows.sparkSession.sparkContext.broadcast((m, b))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("y", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m, b = matrix.value
        for batch in batches:
            v = batch.column(len(keys))
            lens = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = np.nan_to_num(v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            begin = np.concatenate([[0], np.cumsum(lens)])
            y = np.zeros((len(v), m.shape[1]))
            for n in np.unique(lens).tolist():
                own = np.flatnonzero(lens == n)
                use = min(n, len(m))
                y[own] = flat[begin[own][:, None] + np.arange(use)] @ m[:use] + b
            null = v.is_null().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(np.where(null, 0, y.shape[1]))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, mask=np.append(null, False)), pa.array(y[~null].ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), lists], names=schema.names)

    return rows.select(*keys, x).mapInArrow(run, schema)


def _linear_joined(rows: DataFrame, keys: list[str], x: str, weights: DataFrame, bias: DataFrame | None) -> DataFrame:
    """Row by row and output by output; the bias is one more place, at which every array has a 1."""
    n_out, width = weights.agg(F.max("out") + 1, F.max("pos") + 1).first()
    long = lambda c: F.col(c).cast("long").alias(c)
    w = weights.select(long("out"), long("pos"), "w").unionByName(weights.sparkSession.range(1).select(F.lit(n_out - 1).cast("long").alias("out"), F.lit(width).cast("long").alias("pos"), F.lit(0.0).alias("w")))
    if bias is not None:
        w = w.unionByName(bias.where(F.col("out") < n_out).select(long("out"), F.lit(width).cast("long").alias("pos"), F.col("b").alias("w")))
    known = rows.where(F.col(x).isNotNull()).select(*keys, F.slice(x, 1, width).alias("_x"))
    ones = F.concat("_x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("_x")), F.array(F.lit(1.0)))
    y = known.select(*keys, F.posexplode(ones).alias("pos", "_v")).join(w, "pos").groupBy(*keys, "out").agg(F.sum(F.col("_v") * F.col("w")).alias("v"))
    y = y.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("out").cast("long"), "v"))).alias("_y"))
    value = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_out - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("_y", j), F.lit(0.0)))
    return y.select(*keys, value.alias("y")).unionByName(rows.where(F.col(x).isNull()).select(*keys, F.lit(None).cast("array<double>").alias("y")))


def transpose(df: DataFrame) -> DataFrame:
    return df.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """An array less its mean, over the root of its population variance and eps."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    scaled = lambda c: let(F.sqrt(total(F.transform(c, lambda v: v * v)) / F.size(c) + eps), lambda r: F.transform(c, lambda v: v / r))
    return let(x, lambda y: let(total(y) / F.size(y), lambda m: let(F.transform(y, lambda v: v - m), scaled)))


def softmax_row(x: Column) -> Column:
    share = lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(e, lambda v: v / t))
    return let(x, lambda y: let(F.array_max(y), lambda m: let(F.transform(y, lambda v: F.exp(v - m)), share)))


def conv1d(x: Column, kernel: list[float], stride: int, pad: int, bias: float = 0.0) -> Column:
    """A one-channel convolution of an array with zeros at the ends."""
    n = F.size(x)
    k = len(kernel)
    count = F.floor((n + 2 * pad - k) / stride).cast("int")

    def at(t):
        s = F.lit(bias)
        for j, w in enumerate(kernel):
            i = t * stride + j - pad
            s = s + F.when((i >= 0) & (i < n), F.get(x, i)).otherwise(0.0) * w
        return s

    return F.transform(F.sequence(F.lit(0), count), at)


def magnitude(x: Column, n: int) -> Column:
    """The root of re^2 + im^2 where the first n values are re and the others im."""
    return let(x, lambda y: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sqrt(F.pow(F.get(y, i), 2) + F.pow(F.get(y, i + n), 2))))


def split_heads(x: Column, heads: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(x, h * width + 1, width))


def attention(df: DataFrame, keys: list[str], order: str, q: str, k: str, v: str, width: int, causal: bool) -> DataFrame:
    """One head over groups of rows: softmax(q k / sqrt(width)) v, each row seeing those up to itself if causal.

    Adds score rows (keys, order, kk, p) summed into `y`. A group is the attention window and so of bounded length.
    """
    right = df.select(*keys, F.col(order).alias("kk"), F.col(k).alias("_k"), F.col(v).alias("_v"))
    d = df.join(right, keys)
    if causal:
        d = d.where(F.col("kk") <= F.col(order))
    d = d.withColumn("s", dot(F.col(q), F.col("_k")) / float(width) ** 0.5)
    w = Window.partitionBy(*keys, order)
    d = d.withColumn("_e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("_e") / F.sum("_e").over(w))
    d = d.select(*keys, order, "p", F.posexplode("_v").alias("c", "x"))
    return d.groupBy(*keys, order, "c").agg(F.sum(F.col("p") * F.col("x")).alias("y"))


def quantize_q8(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blk, pos, d, q) of (keys, pos, v): blocks of 32 with d = amax / 127 and q = round(v / d)."""
    b = df.withColumn("blk", F.floor(F.col("pos") / BLOCK).cast("int"))
    d = b.withColumn("d", F.max(F.abs("v")).over(Window.partitionBy(*keys, "blk")) / 127)
    q = F.when(F.col("d") > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.round(F.col("v") * (1 / F.col("d")))))).otherwise(0)
    return d.select(*keys, "blk", "pos", "d", q.cast("int").alias("q"))


def _blocks(df: DataFrame, id_: str, **more: str) -> DataFrame:
    """Quantized rows (id, blk, pos, q, ...) as a row for each block: its 32 whole numbers as an array, and its scale columns."""
    q = F.map_from_entries(F.collect_list(F.struct((F.col("pos") % BLOCK).cast("int").alias("p"), F.col("q").cast("long").alias("q"))))
    g = df.groupBy(F.col("id").alias(id_), "blk").agg(q.alias("_m"), *[F.max(c).alias(n) for n, c in more.items()])
    places = F.sequence(F.lit(0), F.lit(BLOCK - 1))
    return g.select(id_, "blk", F.transform(places, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0).cast("long"))).alias(f"q{id_}"), *more)


def _meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of blocks of the same number, with the exact sum of their products. A matrix `y` of up to HELD values goes to all executors."""
    y = F.broadcast(y) if y.count() * BLOCK <= HELD else y
    product = F.aggregate(F.zip_with("qa", "qb", lambda u, v: u * v), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.join(y, "blk").withColumn("s", product)


def q8_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, dot) of quantized rows (id, blk, pos, d, q): exact integer sums of each block, then scaled."""
    s = _meet(_blocks(a, "a", da="d"), _blocks(b, "b", db="d"))
    return s.groupBy("a", "b").agg(F.sum(F.col("s") * F.col("da") * F.col("db")).alias("dot"))


def q8_dot_with_minimum(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, dot) of quantized rows `a` (id, blk, pos, d, q) with rows `b` (id, blk, pos, m, d, q), whose values are m + d * q."""
    x = _blocks(a, "a", da="d").withColumn("t", F.aggregate("qa", F.lit(0).cast("long"), lambda s, v: s + v))
    s = _meet(x, _blocks(b, "b", db="d", mb="m"))
    return s.groupBy("a", "b").agg(F.sum(F.col("da") * (F.col("db") * F.col("s") + F.col("mb") * F.col("t"))).alias("dot"))


def block_bytes(dtype: Column) -> Column:
    """Bytes of a block of 32 values by stored type."""
    return F.when(dtype == 2, 18).when(dtype == 3, 20).when(dtype == 6, 22).when(dtype == 7, 24).when(dtype == 8, 34)


def quantize_5bit(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blk, pos, m, d, q): blocks of 32 with minimum m, step d = range / 31 and q from 0 to 31."""
    b = df.withColumn("blk", F.floor(F.col("pos") / BLOCK).cast("int"))
    w = Window.partitionBy(*keys, "blk")
    b = b.withColumn("m", F.min("v").over(w)).withColumn("d", (F.max("v").over(w) - F.col("m")) / 31)
    q = F.when(F.col("d") > 0, F.least(F.lit(31), F.floor((F.col("v") - F.col("m")) / F.col("d") + 0.5))).otherwise(0)
    return b.select(*keys, "blk", "pos", "m", "d", q.cast("int").alias("q"))


def pack_nibbles(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blk, j, nibbles, high): places j and j + 16 of a block share a byte, fifth bits make a 32-bit word."""
    place = F.col("pos") % BLOCK
    low = F.col("q").bitwiseAND(15)
    d = df.withColumn("j", place % 16).groupBy(*keys, "blk", "j").agg(F.sum(F.when(place < 16, low).otherwise(low * 16)).cast("int").alias("nibbles"))
    high = df.groupBy(*keys, "blk").agg(F.sum(F.shiftright("q", 4).cast("long") * F.expr(f"shiftleft(1L, cast(pos % {BLOCK} as int))")).alias("high"))
    return d.join(high, [*keys, "blk"])


def unpack_nibbles(df: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of pack_nibbles: (keys, blk, place, q)."""
    d = df.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("place", F.col("j") + 16 * F.col("half"))
    nibble = F.when(F.col("half") == 0, F.col("nibbles").bitwiseAND(15)).otherwise(F.shiftright("nibbles", 4))
    bit = F.expr("cast(shiftright(high, cast(place as int)) & 1 as int)")
    return d.select(*keys, "blk", "place", (nibble + bit * 16).cast("int").alias("q"))
