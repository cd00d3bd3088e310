"""Repeatable pseudo-random numbers from row keys: no state, no dependence on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

HASH_DIGITS = 13  # 52 bits: exact both as a long and as a double
HASH_RANGE = 16 ** HASH_DIGITS


def row_digest(keys, seed) -> Column:
    """md5 of ``seed-key1-key2...`` as hexadecimal text."""
    parts = [F.lit(str(seed))] + [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("-", *parts))


def row_number_hash(keys, seed) -> Column:
    """The leading digits of the digest as a long in [0, HASH_RANGE)."""
    return F.conv(F.substring(row_digest(keys, seed), 1, HASH_DIGITS), 16, 10).cast("long")


def unit_hash(keys, seed) -> Column:
    """The digest as a double in [0, 1)."""
    return row_number_hash(keys, seed) / F.lit(float(HASH_RANGE))
