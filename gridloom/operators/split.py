"""Train/test splits and folds from row hashes and order statistics: no global sort, no row numbering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_temporal, type_of
from ..functions.hashing import HASH_RANGE, row_number_hash
from .attach import attach
from .order import MAX_RANGES, order_statistics, range_splits

SEED = 42
LATEST = float(2 ** 53)  # where rows without a time sort


def random_split(df: DataFrame, key, fraction: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``is_train``: a narrow pass that gives the same answer under any partitioning."""
    return df.withColumn("is_train", row_number_hash(key, seed) < F.lit(int(fraction * HASH_RANGE)))


def kfold(df: DataFrame, key, folds: int, seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 0..folds-1."""
    share = row_number_hash(key, seed) / F.lit(float(HASH_RANGE))
    return df.withColumn("fold", F.floor(share * folds).cast("int"))


def hash_thresholds(hashed: DataFrame, by, shares) -> DataFrame:
    """Per group: rows ``n`` and ``t``, the hash at rank floor(n * share) for each share.

    ``hashed`` holds the group columns and the hash as ``v``. Hashes are uniform, so equal-width ranges
    serve; a rank past the last row has no hash and every row lies below it.
    """
    step = HASH_RANGE // MAX_RANGES
    splits = [float("-inf"), *[float(i * step) for i in range(1, MAX_RANGES)], float("inf")]
    ranks = [lambda n, s=s: F.floor(n * F.lit(float(s))) for s in shares]
    found = order_statistics(hashed, by, ranks, splits)
    t = F.transform("r", lambda r: F.coalesce(r["v"].cast("long"), F.lit(HASH_RANGE)))
    return found.select(*by, "n", t.alias("t"))


def _with_thresholds(df: DataFrame, target: str, key, shares, seed: int) -> DataFrame:
    hashed = df.select(col(target).alias("y"), row_number_hash(key, seed).cast("double").alias("v"))
    cuts = hash_thresholds(hashed, ["y"], shares).select(
        F.col("y").alias(target), F.col("n").alias("__n"), F.col("t").alias("__t")
    )
    return attach(df.withColumn("__h", row_number_hash(key, seed)), cuts, [target], rows="__n")


def stratified_split(df: DataFrame, target: str, key, fraction: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``is_train`` with the same fraction of every class; a class of one row makes the split random."""
    smallest = df.groupBy(col(target)).count().agg(F.min("count")).first()[0]
    if smallest is not None and smallest < 2:
        return random_split(df, key, fraction, seed)
    cut = _with_thresholds(df, target, key, [fraction], seed)
    return cut.withColumn("is_train", F.col("__h") < F.col("__t")[0]).drop("__h", "__t", "__n")


def stratified_kfold(df: DataFrame, target: str, key, folds: int, seed: int = SEED) -> DataFrame:
    """Add ``fold``: every class is spread evenly over the folds."""
    cut = _with_thresholds(df, target, key, [i / folds for i in range(1, folds)], seed)
    fold = F.size(F.filter("__t", lambda t: t <= F.col("__h"))).cast("int")
    return cut.withColumn("fold", fold).drop("__h", "__t", "__n")


def time_value(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970 (or the number itself) as a double, missing last."""
    dtype, value = type_of(df, time), col(time)
    if isinstance(dtype, T.TimestampType):
        value = F.unix_micros(value)
    elif is_temporal(dtype):
        value = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value.cast("timestamp_ntz"))
    return F.coalesce(value.cast("double"), F.lit(LATEST))


@dataclass
class Boundary:
    """The row at one position of the time order: its time and its hash among equal times."""

    time: float
    hash: int

    def at_or_after(self, time: Column, hashed: Column) -> Column:
        return (time > self.time) | ((time == self.time) & (hashed >= self.hash))


def time_boundaries(df: DataFrame, time: str, key, ranks, seed: int = SEED) -> list[Boundary]:
    """The rows at the given positions ordered by time, equal times by hash."""
    rows = df.select(time_value(df, time).alias("v"), row_number_hash(key, seed).alias("h")).withColumn("all", F.lit(0))
    asked = [lambda n, r=r: F.lit(int(r)) for r in ranks]
    found = order_statistics(rows.select("all", "v"), ["all"], asked, range_splits(rows, "v"), few_groups=True).first()
    edges = []
    for rank, hit in zip(ranks, found["r"] if found else [None] * len(ranks)):
        if hit is None:
            edges.append(Boundary(float("inf"), 0))
        elif rank == hit["below"]:
            edges.append(Boundary(hit["v"], 0))
        else:
            share = (rank - hit["below"] + 0.5) / hit["equal"]
            tied = rows.where(F.col("v") == hit["v"]).select("all", F.col("h").cast("double").alias("v"))
            edges.append(Boundary(hit["v"], hash_thresholds(tied, ["all"], [share]).first()["t"][0]))
    return edges


def time_split(df: DataFrame, time: str, key, fraction: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``is_train``: the first fraction of the rows in time order."""
    cut = int(df.count() * fraction)
    edge = time_boundaries(df, time, key, [cut], seed)[0]
    return df.withColumn("is_train", ~edge.at_or_after(time_value(df, time), row_number_hash(key, seed)))


def time_folds(df: DataFrame, time: str, key, folds: int, seed: int = SEED) -> DataFrame:
    """Add ``block``: block i + 1 is tested by fold i, which trains on all earlier blocks."""
    rows = df.count()
    size = rows // (folds + 1)
    edges = time_boundaries(df, time, key, [rows - (folds - i) * size for i in range(folds)], seed)
    x, h = time_value(df, time), row_number_hash(key, seed)
    return df.withColumn("block", sum((e.at_or_after(x, h).cast("int") for e in edges), F.lit(0)))
