"""Matrices, network layers and quantized blocks over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import linalg as M
from ..tables import table
from .catalog import query
from .views import TENSOR, tensor, vectors

R = lambda c: F.round(c, 6)
LONG = lambda c: F.col(c).cast("long").alias(c)


def _rows(df, value="x"):
    return df.select("vec_id", F.posexplode(value).alias("pos", "v")).select("vec_id", LONG("pos"), R("v").alias("v"))


@query("matmul", f"WITH {TENSOR} SELECT a.vec_id AS r, CAST(b.pos AS BIGINT) AS c, round(sum(a.v * b.v), 6) AS v FROM tensor a JOIN tensor b ON a.pos = b.vec_id WHERE b.vec_id < 64 GROUP BY a.vec_id, b.pos")
def matmul(spark, d):
    """All embeddings times a matrix of 64 rows: the embeddings of the first 64 ids."""
    t = tensor(spark, d)
    a = t.select(F.col("vec_id").alias("r"), F.col("pos").cast("long").alias("k"), "v")
    b = t.where("vec_id < 64").select(F.col("vec_id").alias("k"), F.col("pos").cast("long").alias("c"), "v")
    return M.matmul(a, b).select("r", "c", R("v").alias("v"))


@query("matmul_t", f"WITH {TENSOR} SELECT a.vec_id AS r, b.vec_id AS c, round(sum(a.v * b.v), 6) AS v FROM tensor a JOIN tensor b USING (pos) WHERE b.vec_id < 64 GROUP BY a.vec_id, b.vec_id")
def matmul_t(spark, d):
    """All embeddings times the transpose of that matrix."""
    t = tensor(spark, d).select(F.col("vec_id").alias("r"), F.col("pos").cast("long").alias("c"), "v")
    a, b = t.withColumnRenamed("c", "k"), M.transpose(t.where("r < 64")).withColumnRenamed("r", "k")
    return M.matmul(a, b).select("r", "c", R("v").alias("v"))


@query("linear_bias", f"WITH {TENSOR}, w AS (SELECT i, j, ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 64)) AS j)) SELECT vec_id, CAST(i AS BIGINT) AS pos, round(sum(v * w) + [0.5, -0.25, 0.0, 1.0][i + 1], 6) AS v FROM tensor JOIN w ON pos = j GROUP BY vec_id, i")
def linear_bias(spark, d):
    """A weight matrix of 4 outputs from a table, here one that a rule fills."""
    w = spark.range(4).select(F.col("id").alias("out"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")).withColumn("w", ((F.col("out") * 7 + F.col("pos") * 3) % 11 - 5) / 10)
    bias = spark.createDataFrame([(0, 0.5), (1, -0.25), (3, 1.0)], "out long, b double")
    return _rows(M.linear(vectors(spark, d), ["vec_id"], "x", w, bias), "y")


@query("layernorm", f"WITH {TENSOR} SELECT vec_id, CAST(pos AS BIGINT) AS pos, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 6) AS v FROM tensor WINDOW w AS (PARTITION BY vec_id)")
def layernorm(spark, d):
    return _rows(vectors(spark, d).withColumn("x", M.layer_norm(F.col("x"))))


@query("gelu", f"WITH {TENSOR}, t AS (SELECT vec_id, pos, v * 5 AS v FROM tensor), g AS (SELECT vec_id, pos, v, 0.7978846 * (v + 0.044715 * v * v * v) AS u FROM t) SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(0.5 * v * (1 + (exp(2 * u) - 1) / (exp(2 * u) + 1)), 6) AS v, round(1 / (1 + exp(-v)), 6) AS s, greatest(v, 0.0) AS r FROM g")
def gelu(spark, d):
    t = tensor(spark, d).withColumn("v", F.col("v") * 5)
    return t.select("vec_id", LONG("pos"), R(S.gelu(F.col("v"))).alias("v"), R(S.sigmoid(F.col("v"))).alias("s"), S.relu(F.col("v")).alias("r"))


@query("softmax_rows", f"WITH {TENSOR}, e AS (SELECT vec_id, pos, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM tensor) SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM e")
def softmax_rows(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode(M.softmax_row(F.col("x"))).alias("pos", "p"))
    return x.select("vec_id", LONG("pos"), F.round("p", 9).alias("p"))


def _conv(stride, kernel, bias):
    k = ", ".join(f"({j}, {w}::DOUBLE)" for j, w in enumerate(kernel))
    return f"WITH {TENSOR}, k(j, w) AS (VALUES {k}), o AS (SELECT vec_id, unnest(range(0, {64 // stride})) AS t FROM embeddings) SELECT o.vec_id, CAST(t AS BIGINT) AS pos, round(coalesce(sum(v * w), 0) + {bias}, 6) AS v FROM o CROSS JOIN k LEFT JOIN tensor x ON x.vec_id = o.vec_id AND x.pos = t * {stride} + j - 1 GROUP BY o.vec_id, t"


@query("conv1d_s1", _conv(1, [0.5, 1.0, -0.25], 0.1))
def conv1d_s1(spark, d):
    return _rows(vectors(spark, d).withColumn("x", M.conv1d(F.col("x"), [0.5, 1.0, -0.25], 1, 1, 0.1)))


@query("conv1d_s2", _conv(2, [1.0, 1.0, 1.0], 0.0))
def conv1d_s2(spark, d):
    return _rows(vectors(spark, d).withColumn("x", M.conv1d(F.col("x"), [1.0, 1.0, 1.0], 2, 1)))


@query(
    "stft_conv",
    f"WITH {TENSOR}, f AS (SELECT vec_id, t, sum(v * cos(2 * pi() * 3 * (pos - t * 4) / 16)) AS re, sum(-v * sin(2 * pi() * 3 * (pos - t * 4) / 16)) AS im FROM tensor JOIN (SELECT unnest(range(0, 13)) AS t) ON pos >= t * 4 AND pos < t * 4 + 16 GROUP BY vec_id, t) SELECT vec_id, CAST(t AS BIGINT) AS pos, round(sqrt(re * re + im * im), 6) AS v FROM f",
)
def stft_conv(spark, d):
    import math

    re, im = [math.cos(2 * math.pi * 3 * k / 16) for k in range(16)], [-math.sin(2 * math.pi * 3 * k / 16) for k in range(16)]
    both = F.concat(M.conv1d(F.col("x"), re, 4, 0), M.conv1d(F.col("x"), im, 4, 0))
    return _rows(vectors(spark, d).withColumn("x", M.magnitude(both, 13)))


def _attention(causal):
    see = "AND b.n <= a.n" if causal else ""
    return f"""WITH g AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, embedding FROM embeddings), h AS (SELECT label, rn // 8 AS tile, rn % 8 AS n, [x::DOUBLE FOR x IN embedding[1:16]] AS q, [x::DOUBLE FOR x IN embedding[17:32]] AS k, [x::DOUBLE FOR x IN embedding[33:48]] AS v FROM g),
s AS (SELECT a.label, a.tile, a.n, b.n AS kk, list_dot_product(a.q, b.k) / 4.0 AS s, b.v FROM h a JOIN h b ON a.label = b.label AND a.tile = b.tile {see}), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, tile, n)) AS e FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY label, tile, n) AS p FROM e), c AS (SELECT label, tile, n, p, v, unnest(range(0, 16)) AS c FROM p) SELECT label, CAST(tile AS BIGINT) AS tile, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS c, round(sum(p * v[c + 1]), 6) AS y FROM c GROUP BY label, tile, n, c"""


def _attend(spark, d, causal):
    """Attention within windows of eight embeddings of a label, in order of their ids."""
    from pyspark.sql import Window

    n = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    h = vectors(spark, d).withColumn("n", n).withColumns({"tile": F.expr("n div 8"), "n": F.col("n") % 8}).withColumn("h", M.split_heads(F.col("x"), 4, 16))
    h = h.select("label", "tile", "n", F.col("h")[0].alias("q"), F.col("h")[1].alias("k"), F.col("h")[2].alias("v"))
    return M.attention(h, ["label", "tile"], "n", "q", "k", "v", 16, causal).select("label", "tile", "n", LONG("c"), R("y").alias("y"))


@query("attention_single_head", _attention(False))
def attention_single_head(spark, d):
    return _attend(spark, d, False)


@query("attention_causal", _attention(True))
def attention_causal(spark, d):
    return _attend(spark, d, True)


@query("embedding_gather", "SELECT e.event_id, v.label, round(v.embedding[1]::DOUBLE + v.embedding[64]::DOUBLE, 6) AS ends FROM events e JOIN embeddings v ON v.vec_id = e.user_id % 500")
def embedding_gather(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 500).alias("vec_id"))
    return e.join(vectors(spark, d), "vec_id").select("event_id", "label", R(F.col("x")[0] + F.col("x")[63]).alias("ends"))


Q8 = f"{TENSOR}, q8 AS (SELECT vec_id, CAST(pos // 32 AS INT) AS blk, pos, max(abs(v)) OVER (PARTITION BY vec_id, pos // 32) / 127 AS d, v FROM tensor), qq AS (SELECT vec_id, blk, pos, d, CAST(CASE WHEN d > 0 THEN greatest(-127, least(127, round(v * (1 / d)))) ELSE 0 END AS INT) AS q FROM q8)"


@query("q8_quantize", f"WITH {Q8} SELECT vec_id, blk, CAST(pos AS BIGINT) AS pos, round(d, 9) AS d, q FROM qq")
def q8_quantize(spark, d):
    return M.quantize_q8(tensor(spark, d), ["vec_id"]).select("vec_id", "blk", LONG("pos"), F.round("d", 9).alias("d"), "q")


@query("q8_block_sums", f"WITH {Q8} SELECT vec_id, blk, CAST(sum(q) AS BIGINT) AS s, round(max(d) * sum(q), 6) AS scaled FROM qq GROUP BY vec_id, blk")
def q8_block_sums(spark, d):
    q = M.quantize_q8(tensor(spark, d), ["vec_id"])
    return q.groupBy("vec_id", "blk").agg(F.sum("q").alias("s"), R(F.max("d") * F.sum("q")).alias("scaled"))


@query("q8_dot", f"WITH {Q8}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.blk, sum(CAST(a.q AS BIGINT) * b.q) AS s, max(a.d) AS da, max(b.d) AS db FROM qq a JOIN qq b USING (blk, pos) WHERE b.vec_id < 64 GROUP BY a.vec_id, b.vec_id, a.blk) SELECT a, b, round(sum(CAST(s AS DOUBLE) * da * db), 6) AS dot FROM s GROUP BY a, b")
def q8_dot(spark, d):
    """All embeddings times the rows of a matrix, the embeddings of the first 64 ids."""
    q = M.quantize_q8(tensor(spark, d), ["vec_id"]).withColumnRenamed("vec_id", "id")
    return M.q8_dot(q, q.where("id < 64")).select("a", "b", R("dot").alias("dot"))


Q5 = f"{TENSOR}, b5 AS (SELECT vec_id, CAST(pos // 32 AS INT) AS blk, pos, v, min(v) OVER w AS m, (max(v) OVER w - min(v) OVER w) / 31 AS d FROM tensor WINDOW w AS (PARTITION BY vec_id, pos // 32)), q5 AS (SELECT vec_id, blk, pos, m, d, CAST(CASE WHEN d > 0 THEN least(31, floor((v - m) / d + 0.5)) ELSE 0 END AS INT) AS q FROM b5)"


@query("q5_1_quantize", f"WITH {Q5} SELECT vec_id, blk, CAST(pos AS BIGINT) AS pos, q, round(m + d * q, 6) AS back FROM q5")
def q5_1_quantize(spark, d):
    q = M.quantize_5bit(tensor(spark, d), ["vec_id"])
    return q.select("vec_id", "blk", LONG("pos"), "q", R(F.col("m") + F.col("d") * F.col("q")).alias("back"))


@query("nibble_unpack", f"WITH {Q5} SELECT vec_id, blk, CAST(pos % 32 AS BIGINT) AS place, q FROM q5")
def nibble_unpack(spark, d):
    q = M.quantize_5bit(tensor(spark, d), ["vec_id"])
    return M.unpack_nibbles(M.pack_nibbles(q, ["vec_id"]), ["vec_id"]).select("vec_id", "blk", LONG("place"), "q")


@query(
    "block_sizes",
    "WITH t AS (SELECT l_partkey % 10 AS t, CAST(l_quantity AS BIGINT) AS blocks FROM lineitem) SELECT CAST(t AS INT) AS dtype, CAST(CASE t WHEN 2 THEN 18 WHEN 3 THEN 20 WHEN 6 THEN 22 WHEN 7 THEN 24 WHEN 8 THEN 34 ELSE -1 END AS INT) AS bytes, CAST(sum(blocks * CASE t WHEN 2 THEN 18 WHEN 3 THEN 20 WHEN 6 THEN 22 WHEN 7 THEN 24 WHEN 8 THEN 34 ELSE 0 END) AS BIGINT) AS total FROM t GROUP BY t",
)
def block_sizes(spark, d):
    """Lines as tensors of so many blocks of ten types, of which five are stored in blocks: bytes of a block and of all."""
    t = table(spark, d, "lineitem").select((F.col("l_partkey") % 10).cast("int").alias("dtype"), F.col("l_quantity").cast("long").alias("blocks"))
    size = M.block_bytes(F.col("dtype"))
    return t.groupBy("dtype").agg(F.sum(F.col("blocks") * F.coalesce(size, F.lit(0))).alias("total")).select("dtype", F.coalesce(size, F.lit(-1)).alias("bytes"), "total")


@query("q8_dot_with_minimum", f"WITH {Q8}, {Q5[len(TENSOR) + 2:]}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.blk, sum(CAST(a.q AS BIGINT) * b.q) AS s, sum(CAST(a.q AS BIGINT)) AS t, max(a.d) AS da, max(b.d) AS db, max(b.m) AS mb FROM qq a JOIN q5 b USING (blk, pos) WHERE b.vec_id < 64 GROUP BY a.vec_id, b.vec_id, a.blk) SELECT a, b, round(sum(da * (db * CAST(s AS DOUBLE) + mb * CAST(t AS DOUBLE))), 6) AS dot FROM s GROUP BY a, b")
def q8_dot_with_minimum(spark, d):
    """All embeddings in eight bits times the rows of a matrix in five bits with a minimum, the embeddings of the first 64 ids."""
    t = tensor(spark, d)
    a = M.quantize_q8(t, ["vec_id"]).withColumnRenamed("vec_id", "id")
    b = M.quantize_5bit(t.where("vec_id < 64"), ["vec_id"]).withColumnRenamed("vec_id", "id")
    return M.q8_dot_with_minimum(a, b).select("a", "b", R("dot").alias("dot"))
