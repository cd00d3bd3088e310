"""Row filters: membership, ranges, question restrictions, missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame

from ..functions.columns import FRACTIONAL, col, finite_or_null, is_missing


def predicate(column: str, wanted) -> Column | None:
    """A list keeps its members, a ``(low, high)`` tuple keeps the closed range; [] keeps all rows."""
    if isinstance(wanted, tuple):
        low, high = wanted
        return col(column).between(low, high)
    if not wanted:
        return None
    value = col(column)
    if all(isinstance(w, str) for w in wanted):
        value = value.cast("string")
    return value.isin(list(wanted))


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """All restrictions together; the optimizer merges and pushes them into the scan."""
    tests = [predicate(c, wanted) for c, wanted in filters.items()]
    return reduce(lambda d, test: d.where(test), [t for t in tests if t is not None], df)


def apply_question_filters(df: DataFrame, equals: dict) -> DataFrame:
    """Equality restrictions of a question; columns that do not exist are ignored."""
    return apply_filters(df, {c: [v] for c, v in equals.items() if c in df.columns})


def cross_filter(df: DataFrame, column: str, selected) -> DataFrame:
    """Keep the clicked category values; nothing clicked keeps everything."""
    return apply_filters(df, {column: list(selected)})


def sanitize_missing(df: DataFrame) -> DataFrame:
    """Infinities and NaN become null in every fractional column."""
    return df.select(*[
        finite_or_null(col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, FRACTIONAL) else col(f.name)
        for f in df.schema.fields
    ])


def drop_missing(df: DataFrame, subset) -> DataFrame:
    """Drop rows where any of the columns is null or NaN."""
    return reduce(lambda d, c: d.where(~is_missing(df, c)), subset, df)


def preview(df: DataFrame, rows: int, key) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*[col(k) for k in key]).limit(rows)
