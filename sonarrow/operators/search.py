"""Decoding over several steps: beam search that stops by what it finds, and users' functions over rows of scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch

#: No step costs a hypothesis more than this.
LEAST = -30.0


def beam_step(live: DataFrame, scores: DataFrame, keys: list[str], width: int, end: int, context: int) -> DataFrame:
    """A step of all beams: (keys, step, slot, beam, ids, last, total, done, ends), the `width` best continuations of each key.

    `live` is (keys, step, beam, ids, last, total, done), `scores` (keys, beam, id, v) in log-probabilities. A continuation
    ends if it is the end token, which its ids leave out, or if its parent has `context` ids and can take no other; it then
    has its parent's ids, and in the second case its parent's total. `done` counts what ended so far. Of equal totals the
    lower beam comes first, within a beam the likelier and then the smaller id.
    """
    best = Window.partitionBy(*keys, "beam").orderBy(F.col("v").desc(), "id")
    own = scores.select(*keys, "beam", "id", "v", F.row_number().over(best).alias("_rank")).where(F.col("_rank") <= width)
    new = own.join(live, [*keys, "beam"]).withColumn("_total", F.col("total") + F.greatest("v", F.lit(LEAST)))
    order = Window.partitionBy(*keys).orderBy(F.col("_total").desc(), "beam", "_rank")
    new = new.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= width)
    is_end, full = F.col("id") == end, F.size("ids") >= context
    new = new.withColumn("ends", is_end | full)
    goes_on = Window.partitionBy(*keys, "ends").orderBy("slot")
    return new.select(
        *keys,
        (F.col("step") + 1).alias("step"),
        "slot",
        F.when(~F.col("ends"), F.row_number().over(goes_on) - 1).cast("long").alias("beam"),
        F.when(F.col("ends"), F.col("ids")).otherwise(F.array_append("ids", F.col("id"))).alias("ids"),
        "id",
        F.when(full & ~is_end, F.col("total")).otherwise(F.col("_total")).alias("total"),
        (F.col("done") + F.sum(F.col("ends").cast("long")).over(Window.partitionBy(*keys))).alias("done"),
        "ends",
    ).withColumnRenamed("id", "last")


def beam_search(start: DataFrame, scores_of: Callable[[DataFrame], DataFrame], keys: list[str], *, width: int, end: int, context: int, most: int) -> DataFrame:
    """(keys, ids, total, mean, ended, steps): the best hypothesis of each key, the last of equals.

    `start` has a row for each key. `scores_of(live)` gives the next log-probabilities (keys, beam, id, v) of live beams
    (keys, step, beam, ids, last, total, done). A key is done when `width` of its hypotheses have ended, and what is live then
    is given up; or when nothing is live; or after `most` steps, when live beams are hypotheses too. The loop goes on while
    a key has live beams. Each step is a table in the shared folder, so a lost executor costs one step, and keys that are
    done are not looked at again. The mean is over the ids and the end token. A key without scores is in no result.
    """
    spark = start.sparkSession
    root = scratch(spark, "beams")
    live = start.select(*keys).distinct().select(
        *keys, F.lit(0).alias("step"), F.lit(0).cast("long").alias("beam"), F.array().cast("array<bigint>").alias("ids"), F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("done")
    )
    found: list[DataFrame] = []
    for step in range(most):
        path = f"{root}/{step}"
        made = beam_step(live, scores_of(live), keys, width, end, context)
        made.write.parquet(path)
        made = spark.read.schema(made.schema).parquet(path)
        found.append(made.where("ends"))
        live = made.where(~F.col("ends") & (F.col("done") < width)).drop("ends", "slot")
        if live.isEmpty():
            break
    else:
        found.append(made.where(~F.col("ends") & (F.col("done") < width)))
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    mean = F.col("total") / (F.size("ids") + 1)
    last_best = F.max(F.struct(mean.alias("mean"), "step", (~F.col("ends")).alias("_open"), "slot", "ids", "total")).alias("b")
    g = all_found.groupBy(*keys).agg(last_best, F.sum(F.col("ends").cast("long")).alias("ended"), F.max("step").alias("steps"))
    return g.select(*keys, "b.ids", "b.total", "b.mean", "ended", "steps")


def filter_scores(df: DataFrame, tokens: str, scores: str, hook: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
    """`df` with its column of score rows rewritten by `hook(tokens, matrix) -> matrix`, many rows at a time.

    `tokens` is a column of arrays of ids, `scores` one of arrays of doubles; rows of scores of one length are a matrix. The
    hook may change the matrix in place. It runs between masking and choosing, as masks are nulls: a null score is -inf in
    the matrix and -inf comes back as null. Null rows stay null.
    """
    names = df.columns
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == scores else f for f in df.schema])
    at, past = names.index(scores), names.index(tokens)

    def run(batches):
        for b in batches:
            rows = b.column(at).cast(pa.list_(pa.float64()))
            lens = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = rows.flatten().fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
            begin = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])
            ids = [np.array(t or [], np.int64) for t in b.column(past).to_pylist()]
            for n in np.unique(lens[lens > 0]).tolist():
                own = np.flatnonzero(lens == n)
                place = begin[own][:, None] + np.arange(n)
                flat[place] = hook([ids[k] for k in own], flat[place])
            values = pa.array(flat, mask=np.isneginf(flat))
            offsets = pa.array(begin.astype(np.int32), mask=np.append(lens < 0, False))
            cols = [*b.columns]
            cols[at] = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def argmax_last(scores: Column) -> Column:
    """The place (from 0) of the greatest of a row of scores, the last of equals; null if all are."""
    return (F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores))).cast("long")
