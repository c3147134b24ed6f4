"""Session building, and getting this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in every Python worker, once an application: Spark's own file
    server hands the executors a zip of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="pagegrain-"), "pagegrain.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


#: Pages that a worker holds as Python objects at a time.
PAGES = 100


def pieces(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows (PAGES) at most. Spark takes its own sizes from the session when a plan runs, by default 10,000 rows or 64 MB: as Arrow
    buffers that is little, as Python objects it isn't."""
    rows = rows or PAGES
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
