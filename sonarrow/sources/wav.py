"""WAV files as rows. Files are read by Spark's binaryFile source, so from any path it can read, one row for each."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, sample_rate int, channels int, samples array<float>, channel_samples array<array<float>>, error string"


def parse(data: bytes, cut_off: bool = False) -> tuple[int, np.ndarray]:
    """The rate and the samples (frames, channels) of 16-bit PCM. Other chunks are skipped; ValueError says what is wrong.

    With `cut_off` a data chunk that says it is longer than the file is taken as far as it goes.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] != 1 or form[5] != 16:
                raise ValueError("only 16-bit PCM is supported")
            if form[1] == 0:
                raise ValueError("no channels")
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            if len(body) < size and not cut_off:
                raise ValueError("the data chunk is cut off")
            whole = len(body) // (2 * form[1]) * 2 * form[1]
            return form[2], np.frombuffer(body[:whole], "<i2").reshape(-1, form[1])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of samples (frames,) or (frames, channels): clamped to [-1, 1], scaled by 32767 and truncated."""
    x = np.trunc(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2")
    channels = 1 if x.ndim == 1 else x.shape[1]
    data = x.tobytes()
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data


def decoded(files: DataFrame, cut_off: bool = False) -> DataFrame:
    """Rows of SCHEMA from (path, content): samples as fractions of 32768, the mono ones as channel means.

    A file that cannot be read is a row with its error, so that one bad file fails no job.
    """

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rate, x = parse(content, cut_off)
                    x = x / np.float32(32768)
                    out.append((path, rate, x.shape[1], x.mean(axis=1), list(x.T), None))
                except (ValueError, struct.error) as e:
                    out.append((path, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.list_(pa.float32())), pa.string())
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["path", "sample_rate", "channels", "samples", "channel_samples", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of WAV files as they appear under path; cut-off data chunks are tolerated."""
    return decoded(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path), True)


def long_form(wavs: DataFrame) -> DataFrame:
    """(path, i, x) of readable files, as the signal operators take them."""
    return wavs.where("error is null").select("path", F.posexplode("samples").alias("i", "x"))


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """The WAV file of an array of mono samples."""
    return samples.combine(rate, lambda s, r: encode(np.asarray(s), int(r)))
