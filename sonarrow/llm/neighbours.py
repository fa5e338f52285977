"""Approximate nearest neighbours by inner product: an HNSW graph for each shard, searched by blocks of queries.

Equal vectors are indexed once. There are `SHARDS` shards, or more if one would hold over `MOST` vectors; the graph of each
is built in a task of its own and stored as a row of flat arrays. Every block of queries visits every shard, each such pair
in a task of its own, and the shards' results are merged by query. Graphs work on vectors scaled to single precision;
scores are inner products of the original vectors in double precision. A vector with many copies is represented by as many
of its smallest ids as a result can hold besides the query itself, as no further copy can be among the nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import column, tidy
from .hnsw import SEARCH, Graph
from .staging import Stage

#: Shards; distinct vectors of a shard at most, about; queries of a block, about: a block is some half a minute of search.
SHARDS, MOST, QUERIES = 8, 1 << 14, 1 << 15
#: Rows of (shard, block, place) that every executor gets.
SMALL = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, with a component that is not zero and none that is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _apart(spark: SparkSession, n: int) -> DataFrame:
    """(number, place) for numbers below n: integers that hash partitioning by n sends to a partition each, but for a few."""
    i = F.col("id").cast("int")
    found = spark.range(64 * n).groupBy(F.pmod(F.hash(i), F.lit(n)).cast("long").alias("number")).agg(F.min(i).alias("place"))
    return spark.range(n).withColumnRenamed("id", "number").join(found, "number", "left").select("number", F.coalesce("place", F.col("number").cast("int")).alias("place"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """To all executors if it has at most SMALL rows of a few numbers; else Spark may choose."""
    return F.broadcast(df) if rows <= SMALL else df


def _kind(vector: Column, df: DataFrame) -> tuple[str, str]:
    """The element type vectors are kept in, for Spark and numpy: single precision where they have it, else double."""
    single = df.select(vector.alias("v")).schema["v"].dataType.elementType.simpleString() == "float"
    return ("float", "<f4") if single else ("double", "<f8")


def _single(x: np.ndarray) -> np.ndarray:
    """Vectors in single precision, scaled by a power of two so that none is out of its range."""
    top = np.abs(x).max(initial=0)
    return (x if not top else np.ldexp(x.astype(np.float64), -int(np.frexp(top)[1]))).astype(np.float32)


def build(vectors: DataFrame, stage: Stage, *, id_col="vec_id", vector_col="embedding", most_ids: int) -> DataFrame:
    """One row for each shard: shard, flat arrays, and for each indexed vector its `most_ids` smallest ids (as rows of `ids`)."""
    kind, dtype = _kind(column(vector_col), vectors)
    v = vectors.select(column(id_col).alias("id"), column(vector_col).cast(f"array<{kind}>").alias("v")).withColumn("h", F.xxhash64("v"))
    # copies beyond the smallest ids are left out before anything is shuffled
    first = v.withColumn("k", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("k") <= most_ids)
    distinct = stage.put(first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    n = distinct.count()
    shards = max(SHARDS, -(-n // MOST))
    places = _apart(vectors.sparkSession, shards).withColumnRenamed("place", "shard")
    distinct = distinct.withColumn("number", F.pmod(F.xxhash64("h"), F.lit(shards))).join(_small(places, shards), "number").drop("number")

    def make(t):
        t = t.sort_by("h")
        x = np.array(t.column("v").combine_chunks().flatten(), dtype).reshape(len(t), -1)
        g = Graph.build(_single(x))
        row = {k: [b] for k, b in g.arrays().items()}
        ids = t.column("ids").combine_chunks()
        return pa.table({"shard": t.column("shard").slice(0, 1).cast(pa.int32()), "exact": [x.tobytes()], **row, "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64())))})

    schema = "shard int, exact binary, vectors binary, rows binary, links binary, shape binary, ids array<array<long>>"
    index = stage.put(distinct.repartition(shards, "shard").groupBy("shard").applyInArrow(make, schema), "index")
    stage.drop("distinct")
    return index


def search(queries: DataFrame, index: DataFrame, *, id_col="vec_id", vector_col="embedding", k: int = 20, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` nearest found for each query, nearest first, ties to the smaller id.

    A query's own id is no candidate. Fewer candidates than k give fewer rows, no candidates or an empty table none.
    """
    kind, dtype = _kind(column(vector_col), queries)
    q = queries.select(column(id_col).alias("q"), column(vector_col).cast(f"array<{kind}>").alias("v"))
    spark = queries.sparkSession
    blocks = max(1, -(-q.count() // QUERIES))
    shards = max(1, index.count())  # an empty index has no pairs, and no tasks
    # a place for each pair of shard and block; both sides are dealt by it, so that a shard is not one task's alone
    numbered = index.select("shard").withColumn("number", F.row_number().over(Window.orderBy("shard")) - 1)  # a number for each shard
    pairs = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("number", F.col("number").cast("long") * blocks + F.col("block"))
    pairs = pairs.join(_apart(spark, shards * blocks), "number").select("shard", "block", "place")
    blocked = q.withColumn("block", F.pmod(F.xxhash64("q", "v"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("q", "v")).alias("queries"))
    blocked = blocked.join(_small(pairs.drop("shard"), shards * blocks), "block").select("place", "queries").repartition(shards * blocks, "place")
    spread = index.join(_small(pairs.drop("block"), shards * blocks), "shard").drop("shard").repartition(shards * blocks, "place")
    tasks = blocked.join(spread, "place")
    wide = width

    def run(batches):
        for t in batches:
            for r in range(len(t)):
                g = Graph.restore({c: t.column(c)[r].as_py() for c in ("vectors", "rows", "links", "shape")})
                ids = t.column("ids")[r].as_py()
                exact = np.frombuffer(t.column("exact")[r].as_buffer(), dtype).reshape(len(g.vectors), -1)
                seen = np.zeros(len(g.vectors), np.int32)
                own = t.column("queries")[r].values
                vectors = own.field("v")
                x = np.array(vectors.flatten(), np.float64).reshape(len(vectors), -1)
                out: tuple[list, list, list] = ([], [], [])
                for stamp, (name, v) in enumerate(zip(own.field("q").to_pylist(), x, strict=True), 1):
                    found = g.search(_single(v), max(wide, 2 * k), seen, stamp)
                    score = exact[found].astype(np.float64) @ v
                    if len(found) > k + 1:  # the last place may be shared
                        ok = score >= np.partition(score, -k - 1)[-k - 1]
                        found, score = found[ok], score[ok]
                    got = sorted((-s, i) for s, w in zip(score.tolist(), found.tolist(), strict=True) for i in ids[w] if i != name)[:k]
                    out[0].extend([name] * len(got))
                    out[1].extend(i for _, i in got)
                    out[2].extend(-s for s, _ in got)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = tasks.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, *, id_col="vec_id", vector_col="embedding", k: int = 20, width: int = SEARCH) -> DataFrame:
    """Index all usable vectors of `vectors` and search those for which `is_query` holds; see `search`.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor does a row without id. Vectors of
    another length than others are an error of the input. Of rows of equal id the least vector counts. Other columns of
    `vectors` may have any names; but for those that `is_query` asks for they are not read.
    """
    stage = Stage(vectors.sparkSession, "neighbours")
    vector = column(vector_col)
    good = vectors.where(column(id_col).isNotNull() & usable(vector)).groupBy(column(id_col)).agg(F.min(vector).alias(vector_col))
    good = stage.put(good, "good")
    index = build(good, stage, id_col=id_col, vector_col=vector_col, most_ids=k + 1)
    return search(good.where(is_query), index, id_col=id_col, vector_col=vector_col, k=k, width=width)
