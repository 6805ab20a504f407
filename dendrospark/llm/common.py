"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, ensure_checkpoint_dir


#: Caches that a worker process keeps from task to task for one kind of work.
WORKER_CACHES: list = []


def release_memory() -> None:
    """At the start of a task: drops what other work left in this process."""
    for cached in WORKER_CACHES:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> Scratch:
    """A folder of this run under ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return Scratch(spark, tag)


def fold(doc_id: str, parts: int):
    """``crc32(doc_id as text) mod parts``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def whole_text(col: str = "text"):
    """The text, empty if null."""
    return F.coalesce(F.col(col), F.lit(""))


def blocks_for(n: int, rows: int) -> int:
    """How many blocks of about ``rows`` rows hold n rows."""
    return max(1, math.ceil(n / rows))


def byte_slices(batch, column: str, limit: int = 8 << 20):
    """Slices of an Arrow batch whose texts in ``column`` take at most ``limit``
    bytes together; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        seen = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, seen + limit, "right")))
        yield batch.slice(first, last - first)
        first = last
