"""Helpers shared by the operators: stored tables, byte views of Arrow columns, hash partitioning."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import scratch_path

# Fixed value: what separates words everywhere in this subpackage.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later passes start from the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(text: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(col(text), F.lit("")).cast("binary")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(col(text), F.lit(""))


def as_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row`` beside named keys, which so clash with no column."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string Arrow column without nulls, and its len + 1 offsets into them."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def spans_of(at: np.ndarray, limit: int):
    """Runs of rows whose bytes together stay near ``limit`` (a longer row is a run of its own)."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = max(first + 1, min(last, len(at) - 1))
        yield first, last
        first = last


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hand_back() -> None:
    """Give the system the memory that this worker has freed; the allocators keep it otherwise, task after task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run):
    """A function over Arrow batches after whose task the worker, idle or not, holds no freed memory."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole
