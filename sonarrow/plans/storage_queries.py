"""Tables written by the library's own sinks and read back by its sources, and streams with state, against SQL on the tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decoding as D
from ..scratch import scratch
from ..sources import model_source, models
from ..sources.wav_source import WavSource
from ..streaming import stateful, windows
from ..tables import table
from . import sequential_queries  # noqa: F401  its SQL is used here
from .catalog import ORACLE_SQL, query
from .views import SIGNAL, TENSOR, signal, tokens, vectors

R = lambda c: F.round(c, 6)


def _staged(df, name):
    """A stream of the rows of df, by way of a table in the shared folder."""
    path = f"{scratch(df.sparkSession, name)}/in"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("wav_round_trip", f"WITH {SIGNAL} SELECT user_id, i, round(trunc(greatest(-1.0, least(1.0, x / 400)) * 32767) / 32768, 6) AS x FROM signal")
def wav_round_trip(spark, d):
    """Each user's values as a recording of 16 bits, written block by block in any order and read back by ranges of frames."""
    s = signal(spark, d).select("user_id", F.floor(F.col("i") / 50).alias("b"), "i", (F.col("x") / 400).alias("x"))
    blocks = s.groupBy("user_id", "b").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    rows = blocks.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), (F.col("b") * 50).alias("frame"), F.col("s.x").alias("samples"))
    path = scratch(spark, "wav")
    spark.dataSource.register(WavSource)
    rows.write.format("wav_frames").mode("append").option("path", path).option("sample_rate", 16000).save()
    back = spark.read.format("wav_frames").option("frames_per_partition", 4096).option("frames_per_row", 256).load(path)
    user = F.regexp_extract("path", r"u(-?[0-9]+)\.wav$", 1).cast("long")
    back = back.where("error is null").select(user.alias("user_id"), "frame", F.posexplode("samples").alias("k", "x"))
    return back.select("user_id", (F.col("frame") + F.col("k")).alias("i"), R(F.col("x").cast("double")).alias("x"))


@query("gguf_round_trip", f"WITH {TENSOR} SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(v, 6) AS v FROM tensor")
def gguf_round_trip(spark, d):
    """Embeddings, 256 ids a tensor, as a model file that all tasks write, read back by tensors and turned into numbers."""
    v = vectors(spark, d).select(F.expr("vec_id div 256").alias("t"), "vec_id", "x")

    def stack(t):
        t = t.sort_by("vec_id")
        x = np.array(t.column("x").combine_chunks().flatten(), "<f4")
        ids = np.array(t.column("vec_id"), "<f4")  # below 2**24
        return pa.table({"kind": ["tensor"] * 2, "name": [f"{n}.{t.column('t')[0]}" for n in ("vec", "ids")], "dtype": pa.array([0, 0], pa.int32()), "shape": pa.array([[len(t), len(x) // len(t)], [len(t)]], pa.list_(pa.int64())), "value": [x.tobytes(), ids.tobytes()]})

    tensors = v.groupBy("t").applyInArrow(stack, "kind string, name string, dtype int, shape array<long>, value binary")
    hparams = spark.range(len(models.HPARAMS)).select(
        F.lit("hparam").alias("kind"), F.element_at(F.array(*map(F.lit, models.HPARAMS)), (F.col("id") + 1).cast("int")).alias("name"), F.lit(0).alias("dtype"), F.array().cast("array<bigint>").alias("shape"), F.unhex(F.lit("01000000")).alias("value")
    )
    path = f"{scratch(spark, 'gguf')}.gguf".removeprefix("file://")
    model_source.write_gguf(hparams.unionByName(tensors), path)
    back = model_source.read(spark, path).where("kind = 'tensor'").select(F.split("name", r"\.")[0].alias("what"), F.split("name", r"\.")[1].alias("t"), models.numbers("dtype", "value").alias("x"))
    both = back.where("what = 'vec'").select("t", F.col("x").alias("v")).join(back.where("what = 'ids'").select("t", F.col("x").alias("ids")), "t")
    width = (F.size("v") / F.size("ids")).cast("int")
    rows = both.select(F.posexplode("ids").alias("k", "id"), "v", width.alias("w")).select(F.col("id").cast("long").alias("vec_id"), F.slice("v", F.col("k") * F.col("w") + 1, F.col("w")).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), R(F.col("v").cast("double")).alias("v"))


@query("feed_windows_stream", ORACLE_SQL["feed_windows"])
def feed_windows_stream(spark, d):
    """The batch query feed_windows as a stream with chunks of samples as state; each stream's last sample ends it."""
    t = tokens(spark, d).select("user_id", "i", "x", F.col("is_ts").alias("mark"), F.col("tok").alias("tok"))
    t = t.withColumn("ends", F.lead("i").over(Window.partitionBy("user_id").orderBy("i")).isNull())
    with stateful.state_store(spark):
        out = windows.drain(stateful.feed_stream(_staged(t, "samples"), "user_id", 30, 5, 2), ["user_id", "start"], "append")
    return out.select("user_id", "start", "length", "advance", R("mean").alias("mean"))


@query("ring_buffer_stream", f"WITH {SIGNAL}, r AS (SELECT user_id, i, x, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM signal) SELECT user_id, i, x, least(n, 16) - k AS slot, greatest(n - 16, 0) AS dropped FROM r WHERE k <= 16")
def ring_buffer_stream(spark, d):
    """The last 16 samples of each user as a stream's state, and how many it dropped."""
    with stateful.state_store(spark):
        return windows.drain(stateful.ring_stream(_staged(signal(spark, d), "ring"), "user_id", ["i"], 16), ["user_id", "slot"], "append")


@query(
    "grammar_complete",
    "WITH c AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS t FROM benchmark), p AS (SELECT prefix, max(CASE WHEN prefix = t THEN 1 ELSE 0 END) = 1 AS complete FROM (SELECT t, substr(t, 1, CAST(unnest(range(0, length(t) + 1)) AS BIGINT)) AS prefix FROM c) GROUP BY prefix), s AS (SELECT conv_id, turn, lower(substr(text, 1, CAST(turn % 4 AS BIGINT) + 1)) AS said FROM conversations) SELECT conv_id, turn, said, prefix IS NOT NULL AS consistent, coalesce(complete, false) AS complete FROM s LEFT JOIN p ON said = prefix",
)
def grammar_complete(spark, d):
    """Whether the first characters of turns begin, and whether they are, one of the commands."""
    commands = table(spark, d, "benchmark").select(F.lower(F.split("text", " ")[0]).alias("t")).distinct()
    said = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.expr("substring(text, 1, cast(turn % 4 as int) + 1)")).alias("said"))
    return D.progress_of(said, "said", commands, "t").select("conv_id", "turn", "said", "consistent", "complete")
