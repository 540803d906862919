"""Small helpers for the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20


def text_or_empty(text: str) -> Column:
    """The text column as a string, null counting as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def others(df: DataFrame, *taken: str) -> Column:
    """All columns but ``taken`` as one struct; names can then clash with nothing."""
    rest = [c for c in df.columns if c not in taken]
    return F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("_"))


def restore(df: DataFrame, columns: list[str], **taken: Column) -> DataFrame:
    """Undo :func:`others`: the original columns in their order from the struct ``rest``."""
    return df.select(*[
        taken[c].alias(c) if c in taken else F.col("rest").getField(c).alias(c) for c in columns
    ])


def slices(batch: pa.RecordBatch, sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the sizes of its rows add up to ``limit``."""
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def int_bounded(rows: int, per_part: int, least: int = 1) -> int:
    """Number of parts so that each holds about ``per_part``."""
    return max(least, -(-rows // per_part))


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return to the system what a task has freed.

    A worker stays for later tasks, and what the allocators keep of each adds up beside
    the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable, schema: T.StructType, *options) -> DataFrame:
    """``mapInArrow`` with a function that gets the batches and the Arrow schema to return."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        yield from fn(batches, arrow, *options)
        give_back()

    return df.mapInArrow(run, schema)
