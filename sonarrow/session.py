"""One place that builds the session the tests and the bench use."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session pinned to UTC; on a cluster the caller's own session is used instead."""
    b = (
        SparkSession.builder.master(master)
        .appName("sonarrow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of `spark`, once; queries do so before Python tasks import it."""
    sc = spark.sparkContext
    if getattr(sc, "_sonarrow_shipped", None) is None:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="sonarrow-")) / "sonarrow_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(target))
        sc._sonarrow_shipped = str(target)
    return spark
