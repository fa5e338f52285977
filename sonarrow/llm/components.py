"""Connected components of an edge table by alternating large and small stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b. Large: every neighbour above a vertex goes to the least around it; small: those below."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("m"))
    kept = least.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return (moved if large else moved.unionByName(kept)).distinct()


def components(edges: DataFrame, stage: Stage, name: str = "stars") -> DataFrame:
    """(vertex, root) of all vertices of `edges` (a, b): root is the least vertex of the component.

    Each round writes its edges to the shared folder; the rounds grow with the logarithm of the number of vertices.
    """
    now = stage.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}0")
    k = 0
    while True:
        # done when every vertex above hangs on one root that hangs on none
        loose = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").unionByName(now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi"))
        if loose.isEmpty():
            break
        k += 1
        new = stage.put(_stars(_stars(now, True), False), f"{name}{k}")
        stage.drop(f"{name}{k - 1}")
        now = new
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
