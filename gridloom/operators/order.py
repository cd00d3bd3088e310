"""Exact order statistics and running totals without a one-task sort.

Values are split into ranges at approximate quantiles of the whole column, so a group that holds a
third of all rows spreads over a third of the ranges. Counting rows per range tells which ranges hold
the wanted ranks; only their values are shuffled, repeated values once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, as_double, col, same
from ..session import checkpointed
from .attach import broadcastable
from .brackets import whole_quantiles

# Distinct values one aggregation buffer may hold before the distributed form is used.
MAX_BUFFERED_VALUES = 250_000
MAX_RANGES = 4096
BRACKETED = 8  # more quantiles than that are as many comparisons a value; locating them by range costs less


def range_splits(df: DataFrame, value: str) -> list[float]:
    """Cut points that put about equally many rows into each range (bounded sketch, one pass)."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    ranges = max(16, min(MAX_RANGES, wanted))
    cuts = df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    inner = sorted({float(c) for c in cuts if abs(c) != float("inf")}) or [0.0]
    return [float("-inf"), *inner, float("inf")]


def running_totals(df: DataFrame, value: str, weights, by=(), splits=None) -> DataFrame:
    """Add ``below_<w>`` (sum over smaller values) and ``all_<w>`` (group total) for each weight.

    ``value`` must be a double without nulls and unique within its group.
    """
    by = list(by)
    if splits is None:
        splits = range_splits(df, value)
    ranged = Bucketizer(splits=splits, inputCol=value, outputCol="__range").transform(df)
    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by, "__range",
        *[F.coalesce(F.sum(f"__t_{w}").over(earlier), F.lit(0)).alias(f"__o_{w}") for w in weights],
        *[F.sum(f"__t_{w}").over(whole).alias(f"all_{w}") for w in weights],
    )
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"__l_{w}") for w in weights]
    )
    joined = local.join(offsets, same(local, offsets, [*by, "__range"]))
    return joined.select(
        *[local[c] for c in df.columns],
        *[(F.col(f"__l_{w}") + F.col(f"__o_{w}")).alias(f"below_{w}") for w in weights],
        *[F.col(f"all_{w}") for w in weights],
    )


def order_statistics(rows: DataFrame, by, ranks, splits, few_groups: bool = False) -> DataFrame:
    """The values at given ranks (0-based, equal values side by side) of every group.

    ``rows`` holds the group columns and the double ``v``; nulls are not ranked. ``ranks`` are functions
    from the group size column to a rank. Output: the group columns, ``n`` (ranked rows) and ``r``, an
    array of (v, below, equal) with the number of smaller and of equal rows; null for a rank beyond n.
    ``few_groups`` says that the caller bounds the number of groups, which saves measuring it.
    """
    by = list(by)
    ranged = Bucketizer(splits=splits, inputCol="v", outputCol="__range").transform(rows)
    ranged = ranged.withColumn("__range", F.col("__range").cast("int"))
    # Materialized because several steps start from these few counts.
    sizes = checkpointed(ranged.groupBy(*by, "__range").agg(F.count("v").alias("__size")))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(
        *by, "__range", "__size", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy(*by)).alias("n"),
    )
    asked = F.array(*[F.struct(F.lit(i).alias("i"), rank(F.col("n")).cast("long").alias("rank")) for i, rank in enumerate(ranks)])
    here = F.filter(asked, lambda a: (F.col("__before") <= a["rank"]) & (a["rank"] < F.col("__before") + F.col("__size")))
    spots = placed.withColumn("__asked", here).where(F.size("__asked") > 0).select(
        *[F.col(b).alias(f"__s_{b}") for b in by], F.col("__range").alias("__s_range"), "__asked", "__before"
    )
    if few_groups or broadcastable(spots.drop("__asked")):
        spots = F.broadcast(spots)
    match = all_of([F.col("__range") == F.col("__s_range"), *[F.col(b).eqNullSafe(F.col(f"__s_{b}")) for b in by]])
    counted = ranged.join(spots.drop("__asked", "__before"), match, "left_semi").groupBy(*by, "__range", "v").agg(
        F.count(F.lit(1)).alias("__equal")
    )
    smaller = Window.partitionBy(*by, "__range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    located = counted.withColumn("__inside", F.coalesce(F.sum("__equal").over(smaller), F.lit(0))).join(spots, match)
    below = F.col("__before") + F.col("__inside")
    hit = F.filter("__asked", lambda a: (below <= a["rank"]) & (a["rank"] < below + F.col("__equal")))
    value = F.struct("v", below.alias("below"), F.col("__equal").alias("equal"))
    found = located.select(*by, value.alias("value"), hit.alias("hit")).where(F.size("hit") > 0)
    answers = found.select(*by, "value", F.inline("hit")).groupBy(*by).agg(
        F.array(*[F.max(F.when(F.col("i") == i, F.col("value"))) for i in range(len(ranks))]).alias("r")
    )
    # A group without ranked values still gets its row.
    groups = sizes.groupBy(*by).agg(F.sum("__size").alias("n"))
    return groups.join(answers, same(groups, answers, by), "left").select(
        *[groups[b] for b in by], groups["n"], answers["r"]
    )


def _buffered_columns(values: DataFrame, by, names, limit: int) -> list[str]:
    """The columns whose distinct values together fit one aggregation buffer of the largest group."""
    per_group = values.groupBy(*by).agg(*[F.approx_count_distinct(n).alias(n) for n in names])
    found = per_group.agg(*[F.max(n).alias(n) for n in names]).first()
    kept, room = [], limit
    for n in sorted(names, key=lambda n: found[n] or 0):
        room -= found[n] or 0
        if room >= 0:
            kept.append(n)
    return kept


def quantiles(df: DataFrame, columns, probabilities, by=(), limit: int = MAX_BUFFERED_VALUES) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group and column.

    Output: the group columns, ``column``, ``n`` (non-missing values) and ``q`` (array in the order
    of ``probabilities``; null when the group has no value). A few quantiles of a whole table are bracketed
    by sketches. Otherwise columns whose distinct values fit one aggregation buffer use the built-in
    ``percentile``; larger ones are located by range.
    """
    columns, by = list(columns), list(by)
    keys = [f"__by{i}" for i in range(len(by))]
    names = [f"__v{i}" for i in range(len(columns))]
    values = df.select(
        *[col(b).alias(k) for b, k in zip(by, keys)],
        *[as_double(df, c).alias(n) for c, n in zip(columns, names)],
    )
    title = dict(zip(names, columns))
    found = None if by or len(probabilities) > BRACKETED else whole_quantiles(values, names, [float(p) for p in probabilities], limit)
    if found is not None:
        return df.sparkSession.createDataFrame(
            [(title[c], n, q) for c, (n, q) in found.items()], "column string, n long, q array<double>")
    small = _buffered_columns(values, keys, names, limit)
    large = [n for n in names if n not in small]
    parts = []
    if small:
        parts.append(_buffered_quantiles(values, keys, small, title, probabilities))
    if large:
        parts.append(_located_quantiles(values, keys, large, title, probabilities))
    return reduce(DataFrame.unionByName, parts).select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)], "column", "n", "q"
    )


def _buffered_quantiles(values, keys, names, title, probabilities) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    entries = F.array(*[F.struct(F.lit(i).alias("at"), F.col(n).alias("v")) for i, n in enumerate(names)])
    # Counting equal values first leaves the percentile buffers only distinct values to take.
    counted = values.select(*keys, F.inline(entries)).groupBy(*keys, "at", "v").agg(F.count(F.lit(1)).alias("f"))
    found = counted.groupBy(*keys, "at").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("f"))), F.lit(0)).alias("n"),
        F.percentile("v", wanted, F.col("f")).alias("q"),
    )
    column = F.get(F.array(*[F.lit(title[n]) for n in names]), F.col("at"))
    return found.select(*keys, column.alias("column"), "n", "q")


def _located_quantiles(values, keys, names, title, probabilities) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("at"), F.col(n).alias("v")) for i, n in enumerate(names)])
    long = values.select(*keys, F.inline(entries))
    ranks = []
    for p in probabilities:
        ranks += [lambda n, p=p: F.floor((n - 1).cast("double") * p), lambda n, p=p: F.ceil((n - 1).cast("double") * p)]
    found = order_statistics(long, [*keys, "at"], ranks, range_splits(long, "v"), few_groups=not keys)
    interpolated = []
    for i, p in enumerate(probabilities):
        low, high = F.col("r")[2 * i]["v"], F.col("r")[2 * i + 1]["v"]
        spot = (F.col("n") - 1).cast("double") * p
        interpolated.append(low + (high - low) * (spot - F.floor(spot)))
    column = F.get(F.array(*[F.lit(title[n]) for n in names]), F.col("at"))
    return found.select(
        *keys, column.alias("column"), "n", F.when(F.col("n") > 0, F.array(*interpolated)).alias("q")
    )


def quantile_map(df: DataFrame, columns, probabilities) -> dict[str, list[float] | None]:
    """Whole-column quantiles on the driver: one short list per column."""
    if not columns:
        return {}
    rows = quantiles(df, columns, probabilities).collect()
    found = {r["column"]: (list(r["q"]) if r["q"] is not None else None) for r in rows}
    return {c: found.get(c) for c in columns}  # a table without rows has no entry for a column
