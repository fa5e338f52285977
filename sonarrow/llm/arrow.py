"""Appending computed columns to Arrow batches, and what all Arrow tasks here have in common."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, added: list[str] | tuple[str, ...]) -> list[str]:
    """The columns of `df` that none of `added` replaces; names are compared as Spark does, without case."""
    gone = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in gone]


def give_back() -> None:
    """Hand freed memory to the system: Python workers live on, and what one stage left would count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task, after which the worker keeps no more than it needs."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def append(df: DataFrame, source: Column | str, make: Callable[[], Callable[[pa.Array], list]], columns: str, drop: tuple[str, ...] = (), beside: Column | None = None) -> DataFrame:
    """`df` without `drop`, with `columns` (a DDL list) computed from `source` batch by batch; `make` runs once for each task.

    A computed column replaces one of `df` with its name. A `source` that is the name of a column which stays is sent once.
    What `beside` says of each row is sent too, and is the second argument of what `make` makes.
    """
    added = T.StructType.fromDDL(columns)
    kept = others(df, [*added.names, *drop])
    at = kept.index(source) if isinstance(source, str) and source in kept else len(kept)
    source = column(source) if isinstance(source, str) else source
    sent = [*map(column, kept), *([source] if at == len(kept) else []), *([beside] if beside is not None else [])]
    d = df.select(*[c.alias(f"c{i}") for i, c in enumerate(sent)])  # names are looked up on the way to Python, so they are plain
    schema = T.StructType([T.StructField(k, f.dataType, f.nullable, f.metadata) for k, f in zip(kept, d.schema, strict=False)] + list(added))

    two, n_sent = beside is not None, len(sent)

    def run(batches):
        f = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), *(f(b.column(at), b.column(n_sent - 1)) if two else f(b.column(at)))], names=[*kept, *added.names])

    return d.mapInArrow(tidy(run), schema)
