"""What the operators of this subpackage share: text batches, per-worker caches, folds."""

from __future__ import annotations

import ctypes
import os
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, scratch_dir, store

__all__ = ["Scratch", "documents_of", "fold", "give_back", "held_out", "read", "scratch_dir", "small_batches", "store", "text_rows", "worker_cache"]

#: Rows of an Arrow batch, so that a batch of long documents fits a worker.
BATCH_ROWS = 1000
#: Rows of text turned into Python objects at a time, so that long documents do not add up.
TEXT_ROWS = 256


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, under fixed names: other columns, whatever their names, stay out."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def text_rows(batches: Iterator, *names: str, rows: int = TEXT_ROWS) -> Iterator[tuple[list, ...]]:
    """Columns of Arrow batches as Python lists, a few hundred rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)
    give_back()


def worker_cache(key: str, make):
    """One value per Python worker process and key, kept across tasks; the latest eight keys stay."""
    holder = sys.modules.setdefault("_tracewell_worker", types.ModuleType("_tracewell_worker")).__dict__.setdefault("cache", {})
    if key not in holder:
        while len(holder) >= 8:
            holder.pop(next(iter(holder)))
        holder[key] = make()
    return holder[key]


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def held_out(id_col: str, modulus: int, remainder: int):
    return F.coalesce(fold(id_col, modulus) == F.lit(remainder), F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
