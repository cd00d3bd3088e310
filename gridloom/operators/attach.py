"""Joining one row of statistics per key back onto every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, col
from ..session import checkpointed

BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARE = 1000  # a key with at least 1/1000 of all rows is hot: there are at most 1000 of them


def broadcastable(stats: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a small table: text length of all cells plus a fixed cost per cell."""
    cells = [F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) + 32 for c in stats.columns]
    size = stats.agg(F.sum(sum(cells, F.lit(0)))).first()[0] or 0
    return size <= limit


def attach(df: DataFrame, stats: DataFrame, keys, rows: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` plus the statistics columns of its key; ``rows`` is the row count column of ``stats``.

    The statistics are materialized once, so that measuring them does not compute them twice.
    Small statistics are broadcast. Otherwise hot keys are broadcast alone (their number is bounded
    by definition) and the rest is shuffled, where no key is hot any more.
    """
    keys = list(keys)
    extra = [c for c in stats.columns if c not in keys]
    stats = checkpointed(stats.select(
        *[col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
        *[col(c).alias(f"__extra{i}") for i, c in enumerate(extra)],
    ))
    on = all_of(col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys))
    picked = [col(c) for c in df.columns] + [F.col(f"__extra{i}").alias(c) for i, c in enumerate(extra)]

    if broadcastable(stats, limit):
        return df.join(F.broadcast(stats), on).select(*picked)
    size = F.col(f"__extra{extra.index(rows)}")
    total = stats.agg(F.sum(size)).first()[0] or 0
    hot, rest = stats.where(size * HOT_SHARE >= total), stats.where(size * HOT_SHARE < total)
    hot_part = df.join(F.broadcast(hot), on).select(*picked)
    cold = df.join(F.broadcast(hot), on, "left_anti")
    return hot_part.unionByName(cold.join(rest, on).select(*picked))
