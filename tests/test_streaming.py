"""Streams with state: chat turns, the segment sink, feeding by chunks and timers, ring buffers, late data."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarrow.operators import sequential, timeline
from sonarrow.streaming import chat, sinks, stateful, windows


@pytest.fixture(autouse=True)
def store(spark):
    with stateful.state_store(spark):
        yield


def stream_of(spark, d, path, parts, files=1):
    """A stream of the rows of d, a batch for each condition of `parts`."""
    for k, part in enumerate(parts):
        d.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in/part{k}")
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in/part*")


TALK = [(c, t, text) for c in (1, 2, 3) for t, text in enumerate(["hey you there", "  ", "one\n", "hay you two", None, "three", "hey yu four"])]


def test_chat_turns(spark, tmp_path):
    """A stream over three batches and its batch twin; failed turns are in no later request."""

    def reply_of(messages, row):
        if row["turn"] % 3 == 2:
            raise ConnectionError("gone")
        return f" {len(messages)}:{messages[-1]['content'].upper()} \n"

    d = spark.createDataFrame(TALK, "conv_id long, turn long, text string")
    s = stream_of(spark, d, tmp_path, ["turn < 2", "turn between 2 and 3", "turn > 3"])
    got = sinks.drained(chat.chat_stream(s, reply_of, system="S"), "chat").orderBy("conv_id", "turn").collect()
    assert [(r.turn, r.heard, r.error is None) for r in got if r.conv_id == 2] == [(0, "hey you there", True), (2, "one", False), (3, "hay you two", True), (5, "three", False), (6, "hey yu four", True)]
    history = [("system", "S")]
    for r in (r for r in got if r.conv_id == 1):
        assert [(m.role, m.content) for m in r.messages] == [*history, ("user", r.heard)]
        if r.error is None:
            assert r.reply == f"{len(history) + 1}:{r.heard.upper()}"
            history += [("user", r.heard), ("assistant", r.reply)]
        else:
            assert r.error == "ConnectionError: gone" and r.reply is None
    replies = spark.createDataFrame([(r.conv_id, r.turn, r.reply) for r in got], "conv_id long, turn long, reply string")
    twin = chat.chat_turns(d.join(replies, ["conv_id", "turn"], "left"), F.col("reply"), system="S").orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.heard, r.messages, r.reply) for r in twin] == [(r.conv_id, r.turn, r.heard, r.messages, r.reply) for r in got]


def test_wake_phrase(spark, tmp_path):
    d = spark.createDataFrame(TALK, "conv_id long, turn long, text string")
    got = sinks.drained(chat.chat_stream(stream_of(spark, d, tmp_path, ["true"]), lambda m, r: "ok", system="S", wake="Hey you"), "chat").collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c in (1, 2, 3) for t in (0, 3, 6)}
    assert not chat.is_awake("hey", "hey you") and chat.is_awake("HEY YOU!", "hey you")


def test_other_errors_end_the_query(spark, tmp_path):
    d = spark.createDataFrame(TALK, "conv_id long, turn long, text string")
    with pytest.raises(Exception, match="KeyError"):
        sinks.drained(chat.chat_stream(stream_of(spark, d, tmp_path, ["true"]), lambda m, r: r["nothing"], system="S"), "chat")


def test_sink_writes_once(spark, tmp_path):
    """A batch that is replayed after its write leaves its rows once, and the callback can tell."""
    d = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "turn long, text string")
    root, check, seen = f"{tmp_path}/out", f"{tmp_path}/check", []

    def run():
        s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
        sinks.write(s, root, "q", check, on_segments=lambda rows, q, n: seen.append((q, n, rows.count())), availableNow=True).awaitTermination()

    stream_of(spark, d, tmp_path, ["turn < 3", "turn between 3 and 5"])
    run()
    os.remove(f"{check}/commits/1")  # as if the engine had died before it noted the batch
    for crc in (p for p in os.listdir(f"{check}/commits") if p.startswith(".1")):
        os.remove(f"{check}/commits/{crc}")
    d.where("turn > 5").coalesce(1).write.parquet(f"{tmp_path}/in/part2")
    run()
    assert sorted(r.turn for r in sinks.read(spark, root).collect()) == list(range(9))
    assert [n for _, n, _ in seen].count(1) == 2 and {c for *_, c in seen} == {3}
    sinks.put(d.limit(1), 0, root, "other")
    assert sinks.read(spark, root).select("query").distinct().count() == 2
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    (one,) = sinks.sessions(d.where("turn < 2").withColumn("s", F.lit(1)), "s", "turn", m).collect()
    assert one.session == '[{"role":"user","content":"t0"},{"role":"user","content":"t1"}]'


def samples(spark, n_of):
    rng = np.random.default_rng(5)
    rows = [(u, i, float(rng.normal()), bool(rng.random() < 0.2), i == n - 1, int(i) if rng.random() < 0.5 else None) for u, n in n_of.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "user_id long, i long, x double, mark boolean, ends boolean, tok long")


def test_feed_carries_context(spark, tmp_path):
    rows, d = samples(spark, {0: 200, 1: 31, 2: 2, 3: 90})
    s = stream_of(spark, d, tmp_path, [f"i % 200 div 20 = {k}" for k in range(10)])
    got = windows.drain(stateful.feed_stream(s, "user_id", 30, 5, 2, detect=lambda x: "up" if x.mean() > 0 else "down", keep=7), ["user_id", "start"], "append").collect()
    want = sequential.feed_windows(d, ["user_id"], "x", "mark", 30, 5, 2).collect()
    key = lambda f: sorted((r.user_id, r.start, r.length, r.advance, round(r["mean"], 9)) for r in f)
    assert key(got) == key(want)
    for u in (0, 1, 3):
        own = sorted((r for r in got if r.user_id == u), key=lambda r: r.start)
        x, tok = [r[2] for r in rows if r[0] == u], [r[5] for r in rows if r[0] == u]
        assert [r["first"] for r in own] == [True] + [False] * (len(own) - 1)
        assert {r.language for r in own} == {"up" if np.mean(x[: own[0].length]) > 0 else "down"}
        assert [r.context for r in own] == [[t for t in tok[: r.start] if t is not None][-7:] for r in own]


def test_feed_ends_by_a_timer(spark, tmp_path):
    """No mark says that a stream is over: its rest comes when the watermark has passed its last sample by the idle time."""
    rows, d = samples(spark, {0: 75, 1: 40})
    d = d.drop("ends", "tok").withColumn("ts", F.timestamp_seconds(1000 + F.col("i") + 500 * F.col("user_id")))
    clock = [(9, k, 0.0, False, 1000 + 700 * k) for k in range(1, 5)]
    c = spark.createDataFrame(clock, "user_id long, i long, x double, mark boolean, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    s = stream_of(spark, d.unionByName(c), tmp_path, ["user_id < 2 and i < 40", "user_id < 2 and i >= 40", *[f"user_id = 9 and i = {k}" for k in range(1, 5)]])
    got = windows.drain(stateful.feed_stream(s.withWatermark("ts", "1 second"), "user_id", 30, 5, 2, ts="ts", idle=60), ["user_id", "start"], "append").collect()
    want = sequential.feed_windows(d, ["user_id"], "x", "mark", 30, 5, 2).collect()
    key = lambda f: sorted((r.user_id, r.start, r.length, r.advance) for r in f if r.user_id < 2)
    assert key(got) == key(want)


@pytest.mark.parametrize("parts", [["true"], ["i % 3 = 0", "i % 3 = 2", "i % 3 = 1"], [f"i div 4 = {k}" for k in range(6)]])
def test_ring(spark, tmp_path, parts):
    rows = [(u, i, float(i * u)) for u, n in ((1, 3), (2, 23), (3, 9)) for i in range(n)]
    d = spark.createDataFrame(rows, "k long, i long, v double")
    got = windows.drain(stateful.ring_stream(stream_of(spark, d, tmp_path, parts), "k", ["i"], 5), ["k", "slot"], "append").collect()
    want = timeline.last_n(d, ["k"], ["i"], 5).collect()
    assert sorted((r.k, r.slot, r.i, r.v) for r in got) == sorted((r.k, r.slot, r.i, r.v) for r in want)
    assert {(r.k, r.dropped) for r in got} == {(1, 0), (2, 18), (3, 4)}


def test_late_rows_are_dropped(spark, tmp_path):
    """With a watermark, rows that come later than that count no more; without, all do."""
    rows = [(1, 0), (2, 10), (3, 4000), (4, 9000), (5, 20), (6, 8990)]  # the fifth is late
    d = spark.createDataFrame(rows, "n long, t long").select("n", F.timestamp_seconds("t").alias("ts"), F.lit(1.0).alias("value"))
    s = stream_of(spark, d, tmp_path, [f"n = {k}" for k in range(1, 7)])
    total = lambda f: f.agg(F.sum("n")).first()[0]
    late = windows.drain(windows.hops(s, "100 seconds", "100 seconds", "10 minutes").select("window.start", "n"), ["start"])
    assert total(late) == 5 and total(windows.drain(windows.hops(s, "100 seconds", "100 seconds").select("window.start", "n"), ["start"])) == 6
