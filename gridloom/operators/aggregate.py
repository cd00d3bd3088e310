"""Grouped aggregates, rankings, pivots and the data behind bar, line and pie charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, zero_if_null
from .filters import apply_filters
from .order import quantiles

TOP_CATEGORIES = 20
MAX_PIVOT_LEVELS = 1000
AGGREGATES = ("sum", "mean", "min", "max", "median", "count")


def measure(metric: str, agg: str) -> Column:
    """An algebraic aggregate; the sum of a group without values is 0."""
    value = col(metric)
    if agg == "sum":
        return zero_if_null(F.sum(value).cast("double"))
    if agg == "count":
        return F.count(value)
    simple = {"mean": F.avg, "min": F.min, "max": F.max}
    if agg not in simple:
        raise ValueError(f"unknown aggregate {agg!r}")
    return simple[agg](value)


def group_aggregate(df: DataFrame, by, metric: str, agg: str, out: str | None = None) -> DataFrame:
    """One aggregate of one metric per group; a null group is kept."""
    by, out = list(by), out or metric
    if agg != "median":
        return df.groupBy(*[col(b) for b in by]).agg(measure(metric, agg).alias(out))
    middle = quantiles(df, [metric], [0.5], by=by)
    return middle.select(*[col(b) for b in by], F.col("q")[0].alias(out))


def compare(df: DataFrame, category: str, metric: str, agg: str = "mean",
            limit: int = TOP_CATEGORIES, ascending: bool = False) -> DataFrame:
    """Metric per category, best first, with the number of categories before the cut."""
    grouped = group_aggregate(df, [category], metric, agg).where(col(metric).isNotNull())
    # A scalar subquery counts the categories: an unpartitioned window would pull them into one task.
    total = grouped.agg(F.count(F.lit(1))).scalar()
    order = col(metric).asc() if ascending else col(metric).desc()
    best = grouped.orderBy(order, col(category)).limit(limit)
    return best.select(col(category), col(metric), total.alias("total_categories"))


def rank(df: DataFrame, category: str, metric: str, agg: str = "mean",
         limit: int = TOP_CATEGORIES, ascending: bool = False) -> DataFrame:
    return compare(df, category, metric, agg, limit, ascending)


def drill_down(df: DataFrame, category: str, chosen, next_category: str, metric: str, agg: str = "mean") -> DataFrame:
    """The same comparison one level below a chosen category value."""
    return compare(apply_filters(df, {category: [chosen]}), next_category, metric, agg)


def pivot_rows(df: DataFrame, rows: str, value: str, agg: str) -> DataFrame:
    return group_aggregate(df, [rows], value, agg).orderBy(col(rows))


def pivot_levels(df: DataFrame, column: str, limit: int = MAX_PIVOT_LEVELS) -> list[str]:
    """Sorted text levels of a column, refused above the limit so the plan stays narrow."""
    level = F.coalesce(col(column).cast("string"), F.lit("null"))
    found = df.select(level.alias("level")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels; too many for columns")
    return sorted(r["level"] for r in found)


def pivot_long(df: DataFrame, rows: str, columns: str, value: str, agg: str) -> DataFrame:
    """The cells of a cross table as (rows, level, value): any number of levels."""
    labelled = df.select(
        col(rows), F.coalesce(col(columns).cast("string"), F.lit("null")).alias("level"), col(value).alias("value"))
    return group_aggregate(labelled, [rows, "level"], "value", agg)


def pivot_cross(df: DataFrame, rows: str, columns: str, value: str, agg: str, levels=None) -> DataFrame:
    """Rows by column levels; a cell without rows is null. Levels are looked up once if not given."""
    levels = pivot_levels(df, columns) if levels is None else list(levels)
    labelled = df.select(
        col(rows), F.coalesce(col(columns).cast("string"), F.lit("null")).alias("__level"), col(value).alias("__value")
    )
    cells = group_aggregate(labelled, [rows, "__level"], "__value", agg)
    return cells.groupBy(col(rows)).pivot("__level", levels).agg(F.first("__value")).orderBy(col(rows))


def chart_series(df: DataFrame, x: str, y: str, agg: str, color: str | None = None, facet: str | None = None) -> DataFrame:
    """Bar, line or area data over all rows, split by optional color and facet columns."""
    dims = list(dict.fromkeys(d for d in (x, color, facet) if d))
    return group_aggregate(df, dims, y, agg)


def pie_shares(df: DataFrame, category: str, metric: str, agg: str = "sum") -> DataFrame:
    """Aggregate per category and its share of the whole."""
    grouped = group_aggregate(df, [category], metric, agg)
    whole = grouped.agg(F.sum(col(metric))).scalar()
    return grouped.select(col(category), col(metric), F.try_divide(col(metric), whole).alias("share"))


def matrix_long(df: DataFrame, row: str) -> DataFrame:
    """A matrix with a row label column to (row, col, value)."""
    cells = [c for c in df.columns if c != row]
    entries = F.array(*[F.struct(F.lit(c).alias("col"), col(c).cast("double").alias("value")) for c in cells])
    return df.select(col(row).alias("row"), F.inline(entries))


