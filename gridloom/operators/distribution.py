"""Histograms, box plots and capped samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, finite_or_null
from ..functions.hashing import row_digest
from .attach import attach
from .order import quantiles

HISTOGRAM_BINS = 30
PREFIX_DIGITS = 4


def _finite(df: DataFrame, column: str) -> DataFrame:
    value = finite_or_null(col(column).cast("double"))
    return df.select(value.alias("v")).where(F.col("v").isNotNull())


def _bin_table(values: DataFrame, bins: int) -> DataFrame:

    return values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over finite values, the last one closed; empty bins are listed with 0."""
    values = _finite(df, column)
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if edges["lo"] is None:
        return values.select(
            F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"), F.lit(0.0).alias("bin_end"),
            F.lit(0).cast("long").alias("count"),
        ).limit(0)
    lo, hi = edges["lo"], edges["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _bin_table(values, bins).join(counted, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def nice_step(low: float, high: float, max_bins: int = HISTOGRAM_BINS) -> float:
    """The smallest step of 1, 2 or 5 times a power of ten that needs at most ``max_bins`` bins."""
    span = (high - low) or abs(low) or 1.0
    power = math.floor(math.log10(span / max_bins)) - 1
    steps = [digit * 10.0 ** e for e in range(power, power + 4) for digit in (1, 2, 5)]
    for step in sorted(steps):
        if math.floor(high / step) - math.floor(low / step) + 1 <= max_bins:
            return step
    return steps[-1]


def nice_histogram(df: DataFrame, column: str, max_bins: int = HISTOGRAM_BINS, step: float | None = None) -> DataFrame:
    """Bins on round numbers, non-empty bins only."""
    values = _finite(df, column)
    if step is None:
        edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        step = nice_step(edges["lo"] or 0.0, edges["hi"] or 1.0, max_bins)
    return values.groupBy(F.floor(F.col("v") / step).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    ).select((F.col("bin") * step).alias("bin_start"), ((F.col("bin") + 1) * step).alias("bin_end"), "count")


def _boxes(df: DataFrame, category: str, value: str, reach: float) -> DataFrame:
    quarters = quantiles(df, [value], [0.25, 0.5, 0.75], by=[category])
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return quarters.select(
        col(category), F.col("n"), q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"),
        (q1 - reach * (q3 - q1)).alias("low_fence"), (q3 + reach * (q3 - q1)).alias("high_fence"),
    )


def boxplot(df: DataFrame, category: str, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside the fences) and outlier count per category."""
    boxes = _boxes(df, category, value, reach)
    rows = df.select(col(category), as_double(df, value).alias("__value"))
    fenced = attach(rows, boxes, [category], rows="n")
    v = F.col("__value")
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    return fenced.groupBy(col(category)).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def boxplot_outliers(df: DataFrame, category: str, value: str, reach: float = 1.5) -> DataFrame:
    """The values beyond the fences of their category."""
    rows = df.select(col(category), as_double(df, value).alias("__value"))
    fenced = attach(rows, _boxes(df, category, value, reach), [category], rows="n")
    v = F.col("__value")
    return fenced.where(~v.between(F.col("low_fence"), F.col("high_fence"))).select(col(category), v.alias(value))


def sample_rows(df: DataFrame, cap: int, key, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows, chosen by the hash of their key; smaller inputs pass through.

    One pass counts the rows per hash prefix, which gives both the size and a cut that leaves only
    a little more than ``cap`` rows for the final ordering.
    """
    digest = row_digest(key, seed)
    prefix = F.substring(digest, 1, PREFIX_DIGITS)
    sizes = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    if sum(r["n"] for r in sizes) <= cap:
        return df
    seen, last = 0, None
    for r in sizes:
        seen, last = seen + r["n"], r["p"]
        if seen >= cap:
            break
    return (
        df.withColumn("__digest", digest).where(F.substring("__digest", 1, PREFIX_DIGITS) <= last)
        .orderBy("__digest", *[col(c) for c in df.columns]).limit(cap).drop("__digest")
    )


def scatter(df: DataFrame, x: str, y: str, key=(), cap: int | None = None, seed: int = 0) -> DataFrame:
    """Two numeric columns without missing values; with a cap, a sample of so many rows by their key."""
    keys = [c for c in key if c not in (x, y)]
    rows = df.select(col(x), col(y), *[col(k) for k in keys]).where(col(x).isNotNull() & col(y).isNotNull())
    return (rows if cap is None else sample_rows(rows, cap, key, seed)).select(col(x), col(y))
