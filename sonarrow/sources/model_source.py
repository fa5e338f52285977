"""Model files as a Spark data source: a tensor's bytes are read by the task that needs them, and written at their place.

    read(spark, "/models").where("kind = 'tensor' and name in ('encoder.conv1.weight', 'encoder.conv1.bias')")

Rows are those of models.SCHEMA. Each file's index is read once, by the driver, in blocks: parameters, names, and where each
value lies. Equality and membership of kind and name are pushed down to it, so that tasks are made only for values that are asked for, of at most a range of bytes or one tensor each.
"""

from __future__ import annotations

import base64
import json
import os
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from . import models
from .files import Places, listed

#: Bytes of values of a partition, if it has more than one.
RANGE = 64 << 20
NAMES = ["path", "kind", "name", "dtype", "shape", "value", "error"]
KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string()]


class _Index(models._Reader):
    """A reader of a file that gives the places of large values in place of their bytes."""

    def __init__(self, file: Places):
        self.file, self.place = file, 0

    @property
    def at(self):
        return self.place

    @at.setter
    def at(self, value):
        self.place = value

    def take(self, n: int) -> bytes:
        self.file.at = self.place
        b = self.file.take(n)
        if len(b) < n:
            raise ValueError("the file is cut off")
        self.place += n
        return b

    def span(self, n: int):
        if self.place + n > self.file.size:
            raise ValueError("the file is cut off")
        self.place += n
        return self.place - n, n

    def end(self) -> bool:
        return self.place >= self.file.size


class Values(InputPartition):
    """Rows of a file: (kind, name, dtype, shape, value), the value as bytes or as (place, length)."""

    def __init__(self, path: str, rows: list[tuple], error: str | None = None):
        self.path, self.rows, self.error = path, rows, error


def partitions(path: str, rows: list[tuple], most: int) -> list[Values]:
    out, held, n = [], [], 0
    for row in rows:
        size = row[4][1] if isinstance(row[4], tuple) else len(row[4])
        if held and n + size > most:
            out.append(Values(path, held))
            held, n = [], 0
        held.append(row)
        n += size
    return [*out, Values(path, held)] if held else out


class ModelReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range = options["path"], int(options.get("bytes_per_partition", RANGE))
        self.vad, self.architecture = options.get("vad", "false").lower() == "true", options.get("architecture")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("kind", "name") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def _asked(self, kind, name) -> bool:
        return all(v in self.wanted[c] for c, v in (("kind", kind), ("name", name)) if c in self.wanted)

    def partitions(self):
        out = []
        for path, _ in listed(self.path):
            file = Places(path)
            try:
                rows = [r for r in models.parsed(_Index(file), self.vad, self.architecture) if self._asked(r[0], r[1])]
            except (ValueError, struct.error) as e:
                if not self.wanted:  # its kind and name are null
                    out.append(Values(path, [], str(e)))
            else:
                out += partitions(path, rows, self.range)
            finally:
                file.close()
        return out or [Values("", [])]

    def read(self, partition):
        if partition.error is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((partition.path, None, None, None, None, None, partition.error), KINDS, strict=True)], names=NAMES)
        if not partition.rows:
            return
        file, held, n = Places(partition.path), [], 0
        try:
            for kind, name, dtype, shape, value in partition.rows:
                if isinstance(value, tuple):
                    file.at = value[0]
                    value = file.take(value[1])
                held.append((partition.path, kind, name, dtype, list(shape), value, None))
                n += len(value)
                if n > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)
        finally:
            file.close()


@dataclass
class Done(WriterCommitMessage):
    tensors: int


class GgufWriter(DataSourceWriter):
    """Tensors go to their places in a file of another name; the head, and then the name, are given when all are there."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.head, self.places = base64.b64decode(options["head"]), json.loads(options["places"])
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"

    def write(self, iterator):
        fd, n = os.open(self.partial, os.O_RDWR | os.O_CREAT, 0o644), 0
        try:
            for row in iterator:
                at, data = self.places[row["name"]], memoryview(models.gguf_bytes(row["dtype"], bytes(row["value"])))
                while data:
                    k = os.pwrite(fd, data, at)
                    data, at = data[k:], at + k
                n += 1
        finally:
            os.close(fd)
        return Done(n)

    def commit(self, messages):
        n = sum(m.tensors for m in messages if m is not None)
        if n != len(self.places) - 1:
            raise ValueError(f"{n} tensors were written of {len(self.places) - 1}")
        fd = os.open(self.partial, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.truncate(fd, self.places[""])
            os.pwrite(fd, self.head, 0)
            os.fsync(fd)
        finally:
            os.close(fd)
        os.replace(self.partial, self.path)

    def abort(self, messages):
        if os.path.exists(self.partial):
            os.remove(self.partial)


class ModelSource(DataSource):
    """Options: path (a file or a folder, in any store Arrow opens), bytes_per_partition, vad, architecture."""

    @classmethod
    def name(cls):
        return "model"

    def schema(self):
        return models.SCHEMA

    def reader(self, schema):
        return ModelReader(self.options)

    def writer(self, schema, overwrite):
        return GgufWriter(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of models.SCHEMA of the file, or all files under the folder, `path`; a file that cannot be read is a row with its error.

    Pushing filters down to Python sources is a setting of the session, which is switched on.
    """
    spark.dataSource.register(ModelSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("model").options(**options).load(path)


def write_gguf(rows: DataFrame, path: str, architecture: str = "speech") -> None:
    """Write rows (kind, name, dtype, shape, value) of one model as the GGUF file `path`, in a folder that all executors share.

    The driver gets parameters, vocabulary and the tensors' names and sizes, no tensor: each task writes its own at the
    place that follows from these. Until all are there `path` is what it was before. Of equal names one is an error.
    """
    spark = rows.sparkSession
    named = rows.withColumn("name", F.when(F.col("kind") == "filters", "mel_filters").otherwise(F.col("name")))
    small = named.where("kind in ('hparam', 'token')").select("kind", "name", "value").collect()
    large = named.where("kind in ('tensor', 'filters')")
    sizes = [(r["name"], r["dtype"], list(r["shape"]), r["n"]) for r in large.select("name", "dtype", "shape", F.length("value").alias("n")).collect()]
    if len({s[0] for s in sizes}) < len(sizes):
        raise ValueError("two tensors have one name")
    tokens = [bytes(r["value"]) for r in sorted((r for r in small if r["kind"] == "token"), key=lambda r: int(r["name"]))]
    order = {n: i for i, n in enumerate(models.HPARAMS)}
    hparams = {r["name"]: bytes(r["value"]) for r in sorted((r for r in small if r["kind"] == "hparam"), key=lambda r: order.get(r["name"], len(order)))}
    head, places = models.gguf_head(hparams, tokens, sizes, architecture)
    spark.dataSource.register(ModelSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source has it
    large.select("name", "dtype", "value").write.format("model").mode("append").option("path", path).option("head", base64.b64encode(head).decode()).option("places", json.dumps(places)).save()
