"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Within each source the documents lie on a line, every one as long as its expected number of copies (target words over
source words). One random offset per source sets a comb of unit spacing on that line, and a document is emitted once
for every tooth it covers. Documents are laid in order of size, so that the words taken come near the target and not
only the documents.

The prefix sum never brings a source into one task: ranks are counted in (source, size class, hash bucket) cells, the
cells' counts are summed up in two short windows (classes of a source, buckets of a class), and documents are numbered
inside their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import column
from .staging import Stage

WORD = r"[^\x20\x09-\x0D]+"
#: Offsets are multiples of 2**-20, so that adding one to an exact product stays exact.
OFFSET_STEPS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of (source, source_size): weights by rank of the source, no target above `most` times its size.

    A target over its limit stops there and its excess goes to the others by weight, until none is above. The result is
    the level at which limited and weighted targets sum up to the whole, found from prefix sums over the sources in
    order of limit per weight. It holds a row for each source, and so do its windows.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "k")
    return (
        ranked.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stopped", (F.col("total") - F.col("full")) / F.col("open") >= F.col("limit") / F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("stopped"), (F.col("total") - F.col("full")) / F.col("open"))).over(Window.partitionBy()))
        .select("source", "source_size", F.when(F.col("stopped"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def _size_class(size: Column) -> Column:
    """The number of hexadecimal digits and the first two of them: classes a few per cent wide, in order of size."""
    h = F.hex(size)
    return F.concat(F.lpad(F.length(h).cast("string"), 2, "0"), F.substring(h, 1, 2))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, most=2.0) -> DataFrame:
    """Rows of `docs` with how often the mix takes each: (id, text_hash, source, size, source_size, target, copies).

    Null texts have size 0, the null source is a source, rows of equal id are separate documents, an empty table gives an
    empty result. Other columns of `docs`, whatever their names, are not read. Long texts are counted whole. A source without words has target 0 and is not taken. Copies are at most ceil(most) for any document.
    """
    stage = Stage(docs.sparkSession, "mix")
    d = docs.select(column(id_col).alias("_id"), column(source_col).alias("source"), word_count(column(text_col)).alias("size"), F.xxhash64(column(text_col)).alias("text_hash"))
    d = d.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    digest = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    d = d.withColumn("digest", digest).withColumn("class", _size_class(F.col("size"))).withColumn("bucket", F.substring("digest", 1, 2))
    d = stage.put(d, "sized")

    cell = ["key", "class", "bucket"]
    cells = stage.put(d.groupBy("key", "source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    classes = cells.groupBy("key", "class").agg(F.sum("n").alias("class_n"))
    classes = classes.withColumn("before_class", F.coalesce(F.sum("class_n").over(Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.col("key")), 1, 5), 16, 10).cast("double") / OFFSET_STEPS
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("offset", offset).drop("source")
    in_class = Window.partitionBy("key", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.withColumn("before_cell", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
        .join(classes, ["key", "class"])
        .join(targets, "key")
        .select(*cell, "source_size", "target", "offset", (F.col("before_class") + F.col("before_cell")).alias("before"))
    )
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "digest", "text_hash")) - 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    return (
        d.join(starts, cell)
        .withColumn("rank", rank)
        .withColumn("rate", rate)
        .select(F.col("_id").alias(id_col), "text_hash", F.col("source").alias(source_col), "size", "source_size", "target", crossed.cast("long").alias("copies"))
    )


def emit(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with the columns of `docs`.

    Rows that agree in id, text and source are one document here, with the copies of all of them; which one's other columns
    are kept is not defined. Null ids, texts and sources are values like others, and an empty table gives an empty one. The
    columns of `docs` may have any names.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    taken = taken.toDF("id", "hash", "source", "size", "source_size", "target", "copies").groupBy("id", "hash", "source").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    # the rows themselves are one column, so that no name of theirs can be mistaken for one of these
    own = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(id_col).alias("own_id"), F.xxhash64(column(text_col)).alias("own_hash"), column(source_col).alias("own_source"))
    joined = own.join(taken, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")) & F.col("own_source").eqNullSafe(F.col("source")))
    repeated = joined.where("rows > 1").dropDuplicates(["id", "hash", "source"])
    return joined.where("rows = 1").unionByName(repeated).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
