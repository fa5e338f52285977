"""Data sources: growing recordings as streams, files written in place, model files by byte ranges."""

import os
import struct

import numpy as np
import pytest

from sonarrow.sources import model_source, models, wav
from sonarrow.sources.model_source import write_gguf
from sonarrow.sources.wav_source import WavReader, WavSource, WavWriter, Written, header


def frames(rows, path):
    """The samples of a file by frame, from rows in any order; each frame once."""
    got = {}
    for r in rows:
        if r.path == path:
            for k, x in enumerate(r.samples):
                assert r.frame + k not in got
                got[r.frame + k] = x
    return [got[k] for k in sorted(got)] if sorted(got) == list(range(len(got))) else None


def ramp(n, channels=1):
    x = (np.arange(n * channels) % 2000 / 4000 - 0.25).reshape(n, channels)
    return x if channels > 1 else x[:, 0]


def test_ranges(spark, tmp_path):
    spark.dataSource.register(WavSource)
    (tmp_path / "a.wav").write_bytes(wav.encode(ramp(1000), 8000))
    (tmp_path / "b.wav").write_bytes(wav.encode(ramp(300, 2), 16000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    d = spark.read.format("wav_frames").option("frames_per_partition", 256).option("frames_per_row", 100).load(str(tmp_path))
    rows = d.collect()
    whole = {r.path.split("/")[-1]: r for r in wav.read(spark, str(tmp_path)).collect()}
    for name in ("a.wav", "b.wav"):
        assert frames(rows, str(tmp_path / name)) == pytest.approx(whole[name].samples)
    assert d.rdd.getNumPartitions() == 6  # 256, 256, 256, 232, 256, and the last 44 with the file that cannot be read
    (bad,) = [r for r in rows if r.error]
    assert bad.path.endswith("bad.wav") and bad.frame is None
    stereo = [c for r in sorted((r for r in rows if r.path.endswith("b.wav")), key=lambda r: r.frame) for c in r.channel_samples[1]]
    assert stereo == pytest.approx(whole["b.wav"].channel_samples[1])


@pytest.mark.parametrize("size", [None, 0, 0xFFFFFFFF])
def test_a_growing_file(spark, tmp_path, size):
    """Frames come once, over triggers and a restart, while the data chunk is longer than the file or has no size yet."""
    spark.dataSource.register(WavSource)
    live, out, check = (str(tmp_path / n) for n in ("live", "out", "check"))
    os.makedirs(live)
    data = bytearray(wav.encode(ramp(5000), 16000))
    if size is not None:
        data[40:44] = struct.pack("<I", size)

    def trigger(upto, other=None):
        with open(f"{live}/x.wav", "wb") as f:
            f.write(data[:upto])
        if other is not None:
            with open(f"{live}/y.wav", "wb") as f:
                f.write(other)
        s = spark.readStream.format("wav_frames").option("frames_per_partition", 1000).load(live)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    trigger(30)  # no header yet
    trigger(44 + 2 * 1500 + 1, wav.encode(ramp(10), 16000))  # half a frame at the end
    trigger(44 + 2 * 1500 + 1)  # nothing new
    trigger(len(data), wav.encode(ramp(700), 16000))
    rows = spark.read.parquet(out).collect()
    want = np.frombuffer(bytes(data[44:]), "<i2") / 32768
    assert frames(rows, f"{live}/x.wav") == pytest.approx(want.tolist())
    assert len(frames(rows, f"{live}/y.wav")) == 700


def recordings(spark, x, name="r", step=64):
    return [(name, k, x[k : k + step].tolist()) for k in range(0, len(x), step)]


def test_write_in_any_order(spark, tmp_path):
    spark.dataSource.register(WavSource)
    rows = recordings(spark, ramp(1000)) + recordings(spark, ramp(130) / 2, "q")
    rows += rows[:3]  # run again
    d = spark.createDataFrame(rows, "name string, frame long, samples array<double>").repartition(5)
    d.write.format("wav_frames").mode("append").option("path", str(tmp_path)).option("sample_rate", 8000).save()
    assert (tmp_path / "r.wav").read_bytes() == wav.encode(ramp(1000), 8000)
    assert (tmp_path / "q.wav").read_bytes() == wav.encode(ramp(130) / 2, 8000)


def test_killed_writes_leave_a_valid_file(spark, tmp_path):
    """Frames of a write that was not committed are no part of the file; running it again leaves one whole file."""
    w = WavWriter({"path": str(tmp_path), "sample_rate": "8000"})
    row = lambda k, x: {"name": "r", "frame": k, "samples": x}
    x = ramp(600)
    w.patch([w.put([row(0, x[:200])])])
    w.put([row(200, x[200:450])])  # killed before the commit
    assert header(str(tmp_path / "r.wav")).frames == 200
    assert wav.parse((tmp_path / "r.wav").read_bytes())[1].ravel().tolist() == np.trunc(x[:200] * 32767).tolist()
    again = [w.put([row(400, x[400:])]), w.put([row(200, x[200:400])]), None]
    w.patch(again)
    w.patch(again)  # a replayed commit
    w.patch([Written({"r": 10})])  # a late one makes nothing shorter
    assert (tmp_path / "r.wav").read_bytes() == wav.encode(x, 8000)
    for bad in ("", "../r", ".r"):
        with pytest.raises(ValueError):
            w.put([{"name": bad, "frame": 0, "samples": [0.0]}])


def test_stream_to_stream(spark, tmp_path):
    """A copy that grows with its recording."""
    from pyspark.sql import functions as F

    spark.dataSource.register(WavSource)
    live, copy, check = (str(tmp_path / n) for n in ("live", "copy", "check"))
    os.makedirs(live)
    for n in (900, 2500):
        with open(f"{live}/x.wav", "wb") as f:
            f.write(wav.encode(ramp(n), 16000))
        s = spark.readStream.format("wav_frames").option("frames_per_partition", 300).load(live)
        s = s.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "frame", (F.transform("samples", lambda x: x * 32768 / 32767)).alias("samples"))
        s.writeStream.format("wav_frames").option("path", copy).option("sample_rate", 16000).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got = wav.parse(open(f"{copy}/x.wav", "rb").read())[1].ravel()
        assert np.abs(got - np.trunc(ramp(n) * 32767)).max() <= 1 and len(got) == n


def ggml(n_tensors=6, n=64):
    f = lambda *v: struct.pack(f"<{len(v)}i", *v)
    data = struct.pack("<I", models.GGML) + f(5, 3, 4, 2, 1, 4, 4, 2, 1, 2, 1) + f(2, 3) + np.arange(6, dtype="<f4").tobytes() + f(3)
    for w in (b"a", b"", b"\xff"):
        data += f(len(w)) + w
    for k in range(n_tensors):
        name = f"t{k:02}".encode()
        data += f(2, len(name), 0) + f(n, 1 + k) + name + np.full(n * (1 + k), k, "<f4").tobytes()
    return data


def test_model_ranges(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(ggml())
    (tmp_path / "n.gguf").write_bytes(models.to_gguf(models.parse(ggml())))
    (tmp_path / "cut.bin").write_bytes(ggml()[:-1])
    want = sorted((f"{tmp_path}/{f}", *r[:3], tuple(r[3]), bytes(r[4])) for f in ("m.bin", "n.gguf") for r in models.parse((tmp_path / f).read_bytes()))
    read = lambda: model_source.read(spark, str(tmp_path), bytes_per_partition=512)
    rows = read().collect()
    assert sorted((r.path, r.kind, r.name, r.dtype, tuple(r.shape), bytes(r.value)) for r in rows if not r.error) == want
    assert [r.path for r in rows if r.error] == [f"{tmp_path}/cut.bin"]
    one = read().where("kind = 'tensor' and name in ('t01', 't05')")
    assert sorted((r.path.split("/")[-1], r.name) for r in one.collect()) == [("m.bin", "t01"), ("m.bin", "t05"), ("n.gguf", "t01"), ("n.gguf", "t05")]
    assert one.rdd.getNumPartitions() == 4 < read().rdd.getNumPartitions()
    assert read().where("kind = 'token' and length(value) = 0").count() == 2
    assert read().where("kind = 'nothing'").count() == 0 and read().where("error is not null").count() == 1


def test_a_tensor_is_read_alone(tmp_path):
    """The index holds places, and a partition no more than its range or one tensor: a sparse file of over 2 GB."""
    f = lambda *v: struct.pack(f"<{len(v)}i", *v)
    path = str(tmp_path / "large.bin")
    head = ggml(0)
    with open(path, "wb") as out:
        out.write(head)
        for k in range(3):
            out.write(f(2, 2, 0) + f(1 << 28, 1) + f"b{k}".encode())
            out.seek(1 << 30, 1)
        out.write(f(1, 1, 0) + f(1) + b"z" + struct.pack("<f", 7.0))
    reader = model_source.ModelReader({"path": path})
    parts = reader.partitions()
    assert os.path.getsize(path) > 3 << 30 and [[r[1] for r in p.rows][-1] for p in parts] == ["2", "b0", "b1", "b2", "z"] or [[r[1] for r in p.rows][-1] for p in parts][1:] == ["b0", "b1", "b2", "z"]
    (batch,) = reader.read(parts[-1])
    assert batch.to_pylist()[0]["value"] == struct.pack("<f", 7.0)
    assert sum(len(r[4]) for p in parts for r in p.rows if not isinstance(r[4], tuple)) < 200


def test_write_gguf(spark, tmp_path):
    rows = models.parse(ggml(40))
    d = spark.createDataFrame([(k, n, t, s, bytes(v)) for k, n, t, s, v in rows], "kind string, name string, dtype int, shape array<long>, value binary").repartition(7)
    path = str(tmp_path / "out.gguf")
    write_gguf(d, path)
    assert open(path, "rb").read() == models.to_gguf(rows)
    assert os.listdir(tmp_path) == ["out.gguf"]
    before = open(path, "rb").read()
    with pytest.raises(ValueError):
        write_gguf(d.union(d.where("name = 't01'")), path)
    broken = d.withColumn("dtype", d["dtype"]).withColumn("value", d["value"])
    from pyspark.sql import functions as F

    calls = broken.withColumn("value", F.when(F.col("name") == "t07", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        write_gguf(calls, path)
    assert open(path, "rb").read() == before


def test_kill_and_retry(tmp_path):
    rows = models.parse(ggml(4))
    tensors = [(n if k == "tensor" else "mel_filters", t, list(s), len(v)) for k, n, t, s, v in rows if k in ("tensor", "filters")]
    head, places = models.gguf_head({n: v for k, n, _, _, v in rows if k == "hparam"}, [v for k, *_, v in rows if k == "token"], tensors)
    import base64
    import json

    options = {"path": str(tmp_path / "x.gguf"), "head": base64.b64encode(head).decode(), "places": json.dumps(places)}
    data = [{"name": n if k == "tensor" else "mel_filters", "dtype": t, "value": v} for k, n, t, _, v in rows if k in ("tensor", "filters")]
    w = model_source.GgufWriter(options)
    w.write(iter(data[:2]))  # an attempt that was lost
    first, second = w.write(iter(data[:3])), w.write(iter(data[3:]))
    with pytest.raises(ValueError):
        w.commit([first])
    w.commit([first, second, None])
    assert (tmp_path / "x.gguf").read_bytes() == models.to_gguf(rows) and os.listdir(tmp_path) == ["x.gguf"]
    w = model_source.GgufWriter(options)
    w.write(iter(data[:1]))
    w.abort([None])
    assert os.listdir(tmp_path) == ["x.gguf"]


def test_reader_options():
    r = WavReader({"path": "/nowhere/at/all"})
    assert r.partitions() == [] and r.o.block == 4096


def test_vad_models(spark, tmp_path):
    """The other container of that magic number, with its own parameters; read as a speech model it is a row with an error."""
    f = lambda *v: struct.pack(f"<{len(v)}i", *v)
    layers = [(129, 128, 3), (128, 64, 3), (64, 64, 3), (64, 128, 3)]
    data = struct.pack("<I", models.GGML) + f(6) + b"silero" + f(5, 1, 2) + f(512, 64) + f(4) + b"".join(f(*x) for x in layers) + f(128, 128, 128, 1)
    data += f(1, 4, 0) + f(2) + b"bias" + struct.pack("<2f", 0.5, -1.0) + f(2, 1, 1) + f(1, 2) + b"w" + np.array([1, 2], "<f2").tobytes()
    (tmp_path / "vad.bin").write_bytes(data)
    for rows in (models.read(spark, str(tmp_path), vad=True).collect(), model_source.read(spark, str(tmp_path), vad="true").collect()):
        got = {r.name: r for r in rows}
        number = lambda k: struct.unpack("<i", bytes(got[k].value))[0]  # noqa: E731, B023
        assert bytes(got["model_type"].value) == b"silero" and [number(f"version_{i}") for i in range(3)] == [5, 1, 2]
        assert (number("window_size"), number("context_size"), number("lstm_hidden_size"), number("final_out")) == (512, 64, 128, 1)
        assert [tuple(number(f"layer_{i}_{k}") for k in ("in", "out", "kernel")) for i in range(4)] == layers
        assert bytes(got["bias"].value) == struct.pack("<2f", 0.5, -1.0) and got["w"].shape == [2, 1] and got["w"].dtype == 1
    assert [r.error is not None for r in model_source.read(spark, str(tmp_path)).collect()] == [True]
    five = data.replace(f(4) + f(*layers[0]), f(5) + f(*layers[0]), 1)
    with pytest.raises(ValueError, match="5 encoder layers"):
        models.parse(five, vad=True)
