"""WAV files as a Spark data source: frame ranges of files as partitions, growing files as a stream, files written in place.

    spark.dataSource.register(WavSource)
    spark.readStream.format("wav_frames").load("/shared/live").writeStream.format("wav_frames").option("path", "/shared/copies")

A row is a block of frames: (path, sample_rate, channels, frame, samples, channel_samples, error).
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import Places, listed

SCHEMA = "path string, sample_rate int, channels int, frame long, samples array<float>, channel_samples array<array<float>>, error string"
#: Frames of a partition and of a row; ranges of a partition; frames of a batch of rows.
RANGE, BLOCK, FILES, BATCH_FRAMES = 1 << 20, 4096, 256, 1 << 16
#: Sizes that a writer leaves while it does not know better.
OPEN_SIZES = (0, 0xFFFFFFFF, 0x7FFFFFFF)
HEADER = 44


@dataclass
class Form:
    rate: int
    channels: int
    begin: int
    frames: int


def header(path: str) -> Form:
    """Rate, channels, where the data begins and how many whole frames are there now.

    A data chunk may be longer than the file, as one that is still written is, or have no size yet.
    """
    f = Places(path)
    try:
        top = f.take(12)
        if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
            raise ValueError("not a RIFF/WAVE file")
        form = None
        while len(chunk := f.take(8)) == 8:
            name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
            if name == b"data":
                if form is None:
                    raise ValueError("data before format")
                there = f.size - f.at
                return Form(form[2], form[1], f.at, max(0, there if size in OPEN_SIZES else min(there, size)) // (2 * form[1]))
            if name == b"fmt ":
                form = struct.unpack("<HHIIHH", f.take(16))
                if form[0] != 1 or form[5] != 16:
                    raise ValueError("only 16-bit PCM is supported")
                if form[1] == 0:
                    raise ValueError("no channels")
                f.at += size - 16 + size % 2
            else:
                f.at += size + size % 2
        raise ValueError("no data chunk")
    finally:
        f.close()


@dataclass
class Range:
    """Frames `first` to `end` of a file, or why it cannot be read."""

    path: str
    form: Form | None
    first: int = 0
    end: int = 0
    error: str | None = None


class Frames(InputPartition):
    """Ranges that one task reads: several small files, or a part of a large one."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def dealt(ranges: list[Range], most: int) -> list[Frames]:
    """Partitions of at most `most` frames and FILES ranges; longer ranges are cut."""
    out, held, n = [], [], 0
    for r in ranges:
        for k in range(r.first, max(r.end, r.first + 1), most):
            part = Range(r.path, r.form, k, min(r.end, k + most), r.error)
            if held and (n + part.end - k > most or len(held) == FILES):
                out.append(Frames(held))
                held, n = [], 0
            held.append(part)
            n += part.end - k
    return [*out, Frames(held)] if held else out


NAMES = ["path", "sample_rate", "channels", "frame", "samples", "channel_samples", "error"]
KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.list_(pa.float32())), pa.string()]


def _rows(r: Range, block: int):
    if r.form is None:
        yield (r.path, None, None, None, None, None, r.error)
        return
    f, width = Places(r.path), 2 * r.form.channels
    try:
        for k in range(r.first, r.end, block):
            f.at = r.form.begin + k * width
            raw = f.take((min(r.end, k + block) - k) * width)
            x = np.frombuffer(raw[: len(raw) // width * width], "<i2").reshape(-1, r.form.channels) / np.float32(32768)
            yield (r.path, r.form.rate, r.form.channels, k, x.mean(axis=1), [c.copy() for c in x.T], None)
    finally:
        f.close()


def read_frames(p: Frames, block: int):
    """Record batches of the blocks of a partition; blocks begin at multiples of `block` from a range's first frame."""
    held: list[tuple] = []
    for row in chain.from_iterable(_rows(r, block) for r in p.ranges):
        held.append(row)
        if len(held) * block >= BATCH_FRAMES:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.range, self.block = int(options.get("frames_per_partition", RANGE)), int(options.get("frames_per_row", BLOCK))
        self.rate, self.channels = int(options.get("sample_rate", 16000)), int(options.get("channels", 1))


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.o = _Options(options)

    def partitions(self):
        out = []
        for path, _ in listed(self.o.path, ".wav"):
            try:
                form = header(path)
            except (ValueError, struct.error) as e:
                out.append(Range(path, None, error=str(e)))
            else:
                out += [Range(path, form, 0, form.frames)] if form.frames else []
        return dealt(out, self.o.range)

    def read(self, partition):
        yield from read_frames(partition, self.o.block)


class WavStreamReader(DataSourceStreamReader):
    """Offsets are the frames of each file that were given out; a file whose header is not there yet waits.

    The offset names every file of the folder, so finished recordings should be moved away at some time.
    """

    def __init__(self, options):
        self.o = _Options(options)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path, _ in listed(self.o.path, ".wav"):
            try:
                out[path] = header(path).frames
            except (ValueError, struct.error):
                continue
        return out

    def partitions(self, start, end):
        return dealt([Range(path, header(path), start.get(path, 0), n) for path, n in sorted(end.items()) if n > start.get(path, 0)], self.o.range)

    def read(self, partition):
        yield from read_frames(partition, self.o.block)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    ends: dict[str, int]


class _InPlace:
    """Frames are written at their own places behind the header, by any task and as often as one is run again; the sizes
    that make them part of the file are written last, when all tasks of a write are through."""

    def __init__(self, options):
        self.o = _Options(options)

    def file(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no name of a recording")
        return os.path.join(self.o.path.removeprefix("file://"), f"{name}.wav")

    def put(self, rows) -> Written:
        ends: dict[str, int] = {}
        os.makedirs(self.o.path.removeprefix("file://"), exist_ok=True)
        width = 2 * self.o.channels
        for row in rows:
            x = np.trunc(np.clip(np.asarray(row["samples"], np.float64), -1, 1) * 32767).astype("<i2")
            if len(x) % self.o.channels:
                raise ValueError(f"{row['name']}: a row holds no whole frames")
            at = HEADER + int(row["frame"]) * width
            fd = os.open(self.file(row["name"]), os.O_RDWR | os.O_CREAT, 0o644)
            try:
                data = memoryview(x.tobytes())
                while data:
                    n = os.pwrite(fd, data, at)
                    data, at = data[n:], at + n
            finally:
                os.close(fd)
            ends[row["name"]] = max(ends.get(row["name"], 0), at - HEADER)
        return Written(ends)

    def patch(self, messages) -> None:
        """A file's data ends where the frames written so far do, whichever write brought them."""
        ends: dict[str, int] = {}
        for m in messages:
            for name, end in (m.ends if m is not None else {}).items():
                ends[name] = max(ends.get(name, 0), end)
        form = struct.pack("<HHIIHH", 1, self.o.channels, self.o.rate, self.o.rate * self.o.channels * 2, self.o.channels * 2, 16)
        for name, end in ends.items():
            fd = os.open(self.file(name), os.O_RDWR)
            try:
                old = os.pread(fd, HEADER, 0)
                end = max(end, struct.unpack("<I", old[40:])[0] if old[:4] == b"RIFF" else 0)
                os.fsync(fd)
                os.pwrite(fd, b"RIFF" + struct.pack("<I", 36 + end) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", end), 0)
            finally:
                os.close(fd)


class WavWriter(_InPlace, DataSourceWriter):
    def write(self, iterator):
        return self.put(iterator)

    def commit(self, messages):
        self.patch(messages)


class WavStreamWriter(_InPlace, DataSourceStreamWriter):
    def write(self, iterator):
        return self.put(iterator)

    def commit(self, messages, batchId):
        self.patch(messages)

    def abort(self, messages, batchId):
        pass


class WavSource(DataSource):
    """Options: path (for reading a file or a folder, in any store Arrow opens; for writing a folder that all executors share
    and that has writes at any place), frames_per_partition, frames_per_row; sample_rate and channels for writing.

    Written are rows (name, frame, samples), samples interleaved: the file `name`.wav gets them from `frame` on. Rows may
    come in any order and be written again. What lies between written frames is silence.
    """

    @classmethod
    def name(cls):
        return "wav_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WavReader(self.options)

    def streamReader(self, schema):
        return WavStreamReader(self.options)

    def writer(self, schema, overwrite):
        return WavWriter(self.options)

    def streamWriter(self, schema, overwrite):
        return WavStreamWriter(self.options)
