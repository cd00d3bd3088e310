"""A metric over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_missing, is_temporal, to_moment, type_of
from .aggregate import measure
from .filters import drop_missing

# The accepted grains and the unit each truncates to.
GRAINS = {"1d": "day", "1w": "week", "1mo": "month", "1y": "year"}


def bucket(moment: Column, grain: str) -> Column:
    """First day of the day, week (from Monday), month or year."""
    return F.to_date(F.date_trunc(GRAINS[grain], moment))


def _over(df: DataFrame, x: Column, date: str, metric: str, agg: str | None) -> DataFrame:
    return (
        df.select(x.alias(date), col(metric))
        .groupBy(col(date)).agg(measure(metric, agg or "sum").alias(metric))
        .orderBy(col(date))
    )


def trend(df: DataFrame, date: str, metric: str, agg: str | None = None, grain: str | None = None) -> DataFrame:
    """Metric over a date, timestamp or text date column, in date order.

    With a grain: bucketed, summed unless told otherwise. Without one, an aggregate is per day.
    With neither, rows pass through, however many there are.
    """
    dtype = type_of(df, date)
    if isinstance(dtype, T.StringType):
        return text_trend(df, date, metric, agg, grain)
    if not is_temporal(dtype):
        raise ValueError(f"{date} is neither a date nor text")
    rows = df.select(col(date), col(metric)).where(col(date).isNotNull() & col(metric).isNotNull())
    if not agg and not grain:
        return raw_trend(df, date, metric)
    return _over(rows, bucket(col(date), grain or "1d"), date, metric, agg)


def raw_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    rows = df.select(col(date), col(metric)).where(col(date).isNotNull() & col(metric).isNotNull())
    return rows.orderBy(col(date), col(metric))


def text_trend(df: DataFrame, date: str, metric: str, agg: str | None = None, grain: str | None = None) -> DataFrame:
    """Text dates, read day first; rows that do not parse drop out, unless none of them parses."""
    rows = df.select(col(date), col(metric))
    parsed = rows.withColumn("__moment", to_moment(col(date)))
    if parsed.where(F.col("__moment").isNotNull()).isEmpty():
        if agg or grain:
            kept = rows.where(col(date).isNotNull())
            return _over(kept, col(date), date, metric, agg)
        return drop_missing(rows, [metric]).where(col(date).isNotNull()).orderBy(col(date), col(metric))
    moments = parsed.where(F.col("__moment").isNotNull()).select(F.col("__moment").alias(date), col(metric))
    if agg or grain:
        x = bucket(col(date), grain) if grain else col(date)
        return _over(moments, x, date, metric, agg)
    return drop_missing(moments, [metric]).orderBy(col(date), col(metric))


def melt_years(df: DataFrame, years, value: str = "value") -> DataFrame:
    """Wide year columns (1997 or F1997) to rows of (Year, value), other columns repeated."""
    keep = [c for c in df.columns if c not in years]
    entries = F.array(*[
        F.struct(F.lit(int(y.replace("F", ""))).cast("long").alias("Year"), col(y).cast("double").alias(value))
        for y in years
    ])
    return df.select(*[col(c) for c in keep], F.inline(entries))


def year_trend(df: DataFrame, years, agg: str | None = None, value: str = "value") -> DataFrame:
    """Melted years, aggregated per year when an aggregate is asked for."""
    long = melt_years(df, years, value)
    if agg:
        long = long.groupBy("Year").agg(measure(value, agg).alias(value))
    return long.where(~is_missing(long, value)).orderBy("Year", value)
