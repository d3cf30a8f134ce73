"""Shared helpers of the corpus operators: inputs, the shared folder, word hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import give_heap_back, materialize, new_path, remove, shared_dir, shuffles_dropped, small_batches  # noqa: F401  (for the operators)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that a task holds few texts at a time as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def give_back() -> None:
    """Free memory goes back to the machine: Python workers outlive their tasks, next to an executor that needs it."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with suppress(OSError, AttributeError):  # another C library than glibc keeps what it freed
        ctypes.CDLL("libc.so.6").malloc_trim(0)
