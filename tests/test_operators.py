"""Known answers and invariants of the signal, time-line, decoding, text and file operators."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarrow.functions import lookups, scalar
from sonarrow.operators import decoding, linalg, render, sequential, signal, text, timeline
from sonarrow.sources import models, wav


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def floats(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_signal_vectors(spark):
    assert value(spark, signal.reflect_pad(floats([1, 2, 3, 4]), 2)) == [3, 2, 1, 2, 3, 4, 3, 2]
    assert value(spark, signal.pad_or_trim(floats([1, 2, 3]), 5)) == [1, 2, 3, 0, 0]
    assert value(spark, signal.pad_or_trim(floats([1, 2, 3]), 2)) == [1, 2]
    assert value(spark, linalg.conv1d(floats(range(8)), [1, 0, 0, 0], 2, 0)) == [0, 2, 4]
    assert value(spark, linalg.conv1d(floats([1] * 6), [1, 1, 1], 2, 1)) == [2, 3, 3]
    x = [((i * 7 + 3) % 13) / 13 - 0.5 for i in range(64)]
    assert np.allclose(value(spark, signal.dft_power(floats(x), 64)), np.abs(np.fft.rfft(x)) ** 2, atol=1e-9)


@pytest.mark.parametrize("n,source,target,want", [(441, 44100, 16000, 160), (160, 16000, 44100, 441)])
def test_resample(spark, n, source, target, want):
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.sin(F.col("id") / 9).alias("x"))
    got = signal.resample_linear(d, ["k"], source, target).orderBy("i").collect()
    assert [r.i for r in got] == list(range(want))
    at = np.minimum(np.arange(want) * source / target, n - 1)
    assert np.allclose([r.x for r in got], np.interp(at, np.arange(n), np.sin(np.arange(n) / 9)), atol=1e-9)


def test_scalars(spark):
    for s, want in ((0.0, "00:00:00.000"), (11.0, "00:00:11.000"), (3725.5, "01:02:05.500"), (360000.0, "100:00:00.000")):
        assert value(spark, scalar.clock(F.lit(s))) == want
    for bits, want in ((0x3C00, 1.0), (0xC000, -2.0), (0x3555, 0.333251953125), (0x0001, 2.0**-24), (0x7C00, math.inf)):
        assert value(spark, scalar.half_to_float(F.lit(bits))) == want
        assert value(spark, scalar.float_to_half(F.lit(want))) == bits
    rng = np.random.default_rng(0)
    x = [float(v) for v in np.concatenate([rng.normal(0, 10.0**k, 40) for k in range(-8, 6)])]
    got = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(scalar.float_to_half(F.col("v")).alias("h")).collect()]
    assert got == np.array(x).astype(np.float16).view(np.uint16).tolist()
    assert value(spark, scalar.gelu(F.lit(1.0))) == pytest.approx(0.84119, abs=1e-4)
    assert value(spark, scalar.json_escape(F.lit('a"\\\n\t\x01'))) == 'a\\"\\\\\\n\\t\\u0001'
    assert value(spark, scalar.csv_quote(F.lit('say "hi"'))) == '"say ""hi"""'
    assert value(spark, scalar.shell_quote(F.lit("it's"))) == "'it'\\''s'"
    assert len(lookups.LANGUAGE_CODES) == len(lookups.LANGUAGE_NAMES) == 100


def spans(p, threshold=0.5, **options):
    """Spans of one stream given as an array, run by run."""
    level = np.where(np.array(p) >= threshold, 1, np.where(np.array(p) < threshold - 0.15, -1, 0))
    cuts = np.flatnonzero(np.diff(level, prepend=9))
    s = sequential.Spans(1, 1000, len(p), **options)
    return [x for a, b in zip(cuts, np.append(cuts[1:], len(p)), strict=True) for x in s.run(int(a), int(b) - 1, int(level[a]))] + list(s.finish())


@pytest.mark.parametrize(
    "p,options,want",
    [
        ([0] * 10 + [0.9] * 5 + [0] * 10, {"min_speech_ms": 0, "min_silence_ms": 0}, [(10, 15)]),
        ([0] * 5 + [0.9] * 2 + [0] * 5, {"min_speech_ms": 5000}, []),
        ([0.9] * 3 + [0.4] * 4 + [0.9] * 2 + [0.1], {"min_speech_ms": 0, "min_silence_ms": 0}, [(0, 9)]),
        ([0.9] * 3 + [0.1] * 2 + [0.9] * 3, {"min_speech_ms": 0, "min_silence_ms": 5}, [(0, 8)]),
        ([0.9] * 30, {"min_speech_ms": 0, "max_speech_s": 0.01}, [(0, 11), (12, 23), (24, 30)]),
        # a silence of over 98 ms that did not end the span is where it is split, and speech goes on after it
        ([0.9] * 50 + [0.0] * 150 + [0.9] * 200, {"min_speech_ms": 0, "min_silence_ms": 300, "max_speech_s": 0.3}, [(0, 50), (200, 400)]),
    ],
)
def test_speech_spans(p, options, want):
    assert spans(p, **options) == want


def test_core_is_the_full_machine_without_minimums(spark):
    rng = np.random.default_rng(4)
    p = rng.random(400)
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(p)], "k int, i long, p double")
    got = sorted((r.start, r.end) for r in timeline.hysteresis(d, ["k"], "p").collect())
    assert got == spans(p, min_speech_ms=0, min_silence_ms=0)


def test_padding_and_map(spark):
    d = spark.createDataFrame([(1, 1, 5, 10, 22), (1, 2, 12, 17, 22)], "u int, k int, start long, `end` long, n long")
    assert [(r.start, r.end) for r in timeline.pad(d, ["u"], 5, F.col("n")).orderBy("k").collect()] == [(0, 11), (11, 22)]
    c = spark.createDataFrame([(1, 1, 0, 5, 20), (1, 2, 10, 15, 20)], "u int, k int, start long, `end` long, n long")
    cut = timeline.crop_map(c, ["u"], 100, 0, F.col("n"))
    assert [(r.processed, r.start) for r in cut.orderBy("k").collect()] == [(0, 0), (105, 10)]
    anchors = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.105, 5.0)], "u int, processed double, original double")
    t = spark.createDataFrame([(1, 0.002), (1, 0.106), (2, 3.0)], "u int, t double")
    assert {r.t: round(r.original, 6) for r in timeline.original_time(t, anchors, ["u"], "t").collect()} == {0.002: 1.002, 0.106: 5.001, 3.0: 3.0}


def test_parse_segments(spark):
    def fold(stream):
        out, start, n = [], None, 0
        for i, ts in stream:
            if ts and start is None:
                start, n = i, 0
            elif ts and n:
                out.append((start, i, n))
                start = None
            elif ts:
                start = i
            elif start is not None:
                n += 1
        if start is not None and n:
            out.append((start, None, n))
        return out

    rng = np.random.default_rng(1)
    stream = [(i, bool(x)) for i, x in enumerate(rng.random(300) < 0.4)]
    d = spark.createDataFrame([(1, i, t) for i, t in stream], "u int, i long, is_ts boolean")
    assert sorted((r.start_i, r.end_i, r.n_text) for r in timeline.parse_segments(d, ["u"]).collect()) == fold(stream)


def test_wrap(spark):
    assert value(spark, timeline.wrap_words(F.lit("one two three four five six seven eight"), 12)) == ["one two", "three four", "five six", "seven eight"]
    assert value(spark, timeline.wrap_words(F.lit("  "), 5)) == []
    d = spark.createDataFrame([(0.0, 9.0, "abcdefgh")], "t0 double, t1 double, text string")
    assert [r.piece for r in timeline.split_by_char(d, 3).orderBy("part").collect()] == ["abc", "def", "gh"]


def test_median(spark):
    for x, want in (([1, 1, 1, 9, 1, 1, 1], [1] * 7),):
        d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "u int, pos int, v double")
        assert [r.v for r in timeline.reflect_median(d, ["u"], "v", len(x)).orderBy("pos").collect()] == want


def monotone(i, j):
    """All monotone paths from (0, 0) to (i, j)."""
    if (i, j) == (0, 0):
        return [[(0, 0)]]
    return [[*p, (i, j)] for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0 for p in monotone(a, b)]


def test_warp(spark):
    path = lambda cost: [tuple(s[0]) for s in sequential.warp(np.array([cost])).tolist()]
    assert path(np.zeros((2, 3))) == [(0, 0), (1, 0), (1, 1), (1, 2)]
    assert path(9 * (1 - np.eye(3))) == [(0, 0), (1, 1), (2, 2)]
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (1, 4), (4, 1), (3, 5), (4, 4)):
        cost = rng.integers(1, 100, (6, n, m)).astype(float) + rng.random((6, n, m)) / 8
        for x, got in zip(cost, sequential.warp(cost).transpose(1, 0, 2).tolist(), strict=True):
            got = [tuple(p) for p in got if p[0] >= 0]
            assert got == min(monotone(n - 1, m - 1), key=lambda p: sum(x[i, j] for i, j in p))
    rows = [(k, i, j, float(rng.random())) for k, (n, m) in enumerate(((3, 4), (3, 4), (2, 5))) for i in range(n) for j in range(m)]
    d = spark.createDataFrame(rows + [(9, 0, 0, 1.0), (9, 1, 1, 1.0)], "u int, tok int, t int, c double")
    got = {(r.u, r.tok): r.onset for r in sequential.onsets(d, ["u"], "tok", "t", "c").collect()}
    want = {}
    for u, n, m in ((0, 3, 4), (1, 3, 4), (2, 2, 5)):
        c = {(i, j): v for k, i, j, v in rows if k == u}
        for i, j in reversed(min(monotone(n - 1, m - 1), key=lambda p: sum(c[x] for x in p))):
            want[u, i] = j
    assert got == want  # the matrix with missing pairs has none


def test_ranking(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([-5.0, -1.0, None, -0.5, -3.0])], "u int, id int, v double")
    assert [(r.v, r.id) for r in decoding.top_k(d, ["u"], 3).orderBy("rank").collect()] == [(-0.5, 3), (-1.0, 1), (-3.0, 4)]
    tie = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "u int, id int, v double")
    assert decoding.argmax_last(tie, ["u"]).first().id == 1
    u = decoding.log_softmax(spark.createDataFrame([(1, i, 0.0) for i in range(4)], "u int, id int, v double"), ["u"])
    assert decoding.entropy(u, ["u"]).first().entropy == pytest.approx(math.log(4))
    assert [len(decoding.temperatures(*x)) for x in ((0, 0.2), (0, 0.3), (0.5, 0))] == [6, 4, 1]


def test_text(spark):
    sim = lambda a, b: value(spark, text.similarity(F.lit(a), F.lit(b)))
    assert sim("cat", "bat") == pytest.approx(2 / 3) and sim("", "") == 1 and sim("abc", "") == 0
    assert text.grammar('root ::= a " " b\na ::= "hi" | "yo"\nb ::= "ann"') == ["hi ann", "yo ann"]
    for bad in ("root ::= [a-z]", 'root ::= "a"*', "root ::= root", "root ::= none", 'root ::= ("a" | "b")'):
        with pytest.raises(ValueError):
            text.grammar(bad)
    vocab = {bytes([i]): i for i in range(256)} | {b"he": 256, b"llo": 257, b"hello": 258, b" the": 259, b"the": 260}
    d = spark.createDataFrame([("hello",), (" the",), ("the",), (None,), ("",)], "t string")
    assert [r.x for r in d.select(text.greedy_encoder(vocab)("t").alias("x")).collect()] == [[258], [259], [260], [], []]
    r = [x.r for x in spark.createDataFrame([("the quick brown fox jumps over it",), ("la " * 80,)], "t string").select(text.compressibility("t").alias("r")).collect()]
    assert r[0] < 2.4 < r[1]


def test_render(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 2.5, " Hello "), (1, 1, 2.5, 5.0, 'say "hi"')], "c int, k int, t0 double, t1 double, text string")
    body = lambda f, *a: f(d, ["c"], "k", *a).first().body
    assert body(render.txt) == 'Hello\nsay "hi"\n'
    assert body(render.srt, 4).startswith("5\n00:00:00,000 --> 00:00:02,500\nHello\n\n6\n")
    assert body(render.csv) == 'start,end,text\n0,2500,"Hello"\n2500,5000,"say ""hi"""\n'


def test_write_all(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 0.0, 2.5, "Hello"), (2, 0, 0.0, 1.0, "x")], "c int, k int, t0 double, t1 double, text string")
    render.write_all(d, ["c"], "k", str(tmp_path / "out"), ("txt", "srt", "json"))
    got = {str(p.relative_to(tmp_path / "out").parent): p.read_text() for p in (tmp_path / "out").rglob("part-*")}
    assert got["txt/key=1"] == "Hello\n" and got["srt/key=2"].startswith("1\n00:00:00,000") and '"text": "x"' in got["json/key=2"]


def test_uniforms():
    u = sequential.uniforms(42, 1000)
    assert all(0 <= x < 1 for x in u) and abs(sum(u) / 1000 - 0.5) < 0.05


def test_blocks():
    f = lambda *x: np.array(x, "<f2").tobytes()
    assert models.dequantized(7, f(0.5, 2.0) + bytes([1, 0, 0, 0]) + bytes([3] + [0] * 15))[:2].tolist() == [11.5, 2.0]
    assert models.dequantized(2, f(1.0) + bytes([0x0F] + [0x88] * 15))[[0, 16]].tolist() == [7.0, -8.0]
    assert models.dequantized(8, f(0.5) + np.arange(-2, 30, dtype="i1").tobytes())[:3].tolist() == [-1.0, -0.5, 0.0]


def test_blocks_as_columns(spark):
    d = spark.createDataFrame([(8, bytearray(np.array([0.5], "<f2").tobytes() + np.arange(-2, 30, dtype="i1").tobytes())), (0, bytearray(np.array([1.5, 2], "<f4").tobytes())), (8, bytearray(3)), (99, bytearray(4)), (0, None)], "t int, v binary")
    got = [r.x for r in d.select(models.numbers("t", "v").alias("x")).collect()]
    assert got[0][:3] == [-1.0, -0.5, 0.0] and len(got[0]) == 32 and got[1:] == [[1.5, 2.0], None, None, None]


def test_model_files(spark, tmp_path):
    f = lambda *x: struct.pack(f"<{len(x)}i", *x)
    data = struct.pack("<I", models.GGML) + f(5, 3, 4, 2, 1, 4, 4, 2, 1, 2, 1) + f(2, 3) + np.arange(6, dtype="<f4").tobytes()
    data += f(3) + b"".join(f(len(w)) + w for w in (b"a", b"", b"\xff"))
    data += f(2, 1, 0, 3, 2) + b"w" + np.arange(6, dtype="<f4").tobytes() + f(2, 2, 8, 32, 1) + b"qq" + struct.pack("<e", 0.5) + bytes(32)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.gguf").write_bytes(models.to_gguf(models.parse(data)))
    (tmp_path / "c.bin").write_bytes(data[:-1])
    (tmp_path / "d.bin").write_bytes(b"none")
    rows = models.read(spark, str(tmp_path)).collect()
    by = lambda end: sorted((r.kind, r.name, r.dtype, tuple(r["shape"]), bytes(r.value)) for r in rows if r.path.endswith(end) and not r.error)
    assert by("a.bin") == by("b.gguf") and len(by("a.bin")) == 11 + 1 + 5 + 2
    assert ("token", "4", 0, (4,), b"[_extra_token_4]") in by("a.bin") and ("tensor", "w", 0, (2, 3), np.arange(6, dtype="<f4").tobytes()) in by("a.bin")
    assert sorted(r.path[-5:] for r in rows if r.error) == ["c.bin", "d.bin"]
    with pytest.raises(ValueError):
        models.parse(models.to_gguf(models.parse(data)), architecture="other")


def test_files(spark, tmp_path):
    x = np.array([[0, 32767], [16384, 0], [-16384, 0]], float) / 32767
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 16000))
    (tmp_path / "b.wav").write_bytes(b"not a wave file at all")
    rows = {r.path[-5:]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].channels == 2 and rows["a.wav"].sample_rate == 16000 and rows["a.wav"].samples == pytest.approx([0.5, 0.25, -0.25], abs=1e-3)
    assert rows["b.wav"].error
    assert wav.long_form(wav.read(spark, str(tmp_path))).count() == 3
    stream = wav.read_stream(spark, str(tmp_path))
    q = stream.writeStream.format("memory").queryName("wavs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wavs").count() == 2
    back = spark.createDataFrame([([0.0, 2.0, -2.0], 8000)], "s array<double>, r int").select(wav.wav_bytes("s", "r").alias("b")).first().b
    assert wav.parse(bytes(back))[1].ravel().tolist() == [0, 32767, -32767]


@pytest.fixture
def stateful(spark):
    from sonarrow.streaming import stateful

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.STATE_STORE)
    yield stateful
    spark.conf.set(key, before)


def test_streams_equal_batches(spark, tmp_path, stateful):
    from sonarrow.streaming import windows

    rng = np.random.default_rng(6)
    ends = [200, 199, 40, 31, 29]
    rows = [(u, i, float(rng.random() * 300), bool(rng.random() < 0.1), i == n - 1) for u, n in enumerate(ends) for i in range(n)]
    d = spark.createDataFrame(rows, "user_id int, i long, x double, mark boolean, ends boolean")
    for k in range(4):
        d.where(F.col("i").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/part{k}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    got = windows.drain(stateful.feed_stream(s, "user_id", 30, 5, 2), ["user_id", "start"], "append")
    want = sequential.feed_windows(d, ["user_id"], "x", "mark", 30, 5, 2)
    key = lambda f: sorted((r.user_id, r.start, r.length, r.advance, round(r["mean"], 9)) for r in f.collect())
    assert key(got) == key(want)
    for u, n in enumerate(ends):  # the last windows are decoded, and at most 2 samples are dropped
        assert n - 2 <= max(r.start + r.advance for r in want.where(F.col("user_id") == u).collect()) <= n
    kept = sequential.feed_windows(d, ["user_id"], "x", "mark", 30, 5, None).collect()
    assert {r.length for r in kept} == {30} and not [r for r in kept if r.user_id == 4]


def test_activation_stream(spark, tmp_path, stateful):
    from sonarrow.streaming import windows

    rows = [(1, 0, "Hey Listener now"), (1, 1, "something else"), (1, 2, "hey listenar, go"), (1, 3, "other"), (2, 0, "one two"), (2, 1, "three four"), (3, 0, None), (3, 1, "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    for k in range(4):
        d.where(F.col("turn") == k).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    got = windows.drain(stateful.activations(s), ["conv_id", "turn"], "append")
    assert {(r.conv_id, r.turn) for r in got.collect() if r.active} == {(1, 2), (1, 3)}
    pairs = [("cat", "bat"), ("", ""), ("abc", ""), ("kitten", "sitting"), ("gr\u00fcn", "grau")]
    sim = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert sim == pytest.approx([stateful.likeness(a, b) for a, b in pairs])
