"""Helpers shared by the corpus operators: tables, the shared folder, written tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column over all rows (one scan, one number)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(col)).cast("long")), F.lit(0))).first()[0])


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


Batches = Iterator[pa.RecordBatch]


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which gives the memory that it no longer needs back to the machine when its task ends.

    A worker lives on for the tasks of later stages; what its allocators keep (some 100 MB after large texts) would add up
    with what other workers and the executor hold.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library has no such call

    return wrapped
