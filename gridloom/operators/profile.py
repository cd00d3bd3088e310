"""Column metadata and value domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    INTEGRAL, as_double, col, is_numeric, is_temporal, numeric_columns, string_columns, to_number, type_of,
    zero_if_null,
)
from .order import quantiles

CONVERTIBLE_SHARE = 0.6
YEAR_RANGE = (1800, 2100)
COLUMNS_AT_ONCE = 40


def per_column(df: DataFrame, columns, measures: dict) -> DataFrame:
    """One aggregation over all columns, returned with one row per column.

    ``measures`` maps an output name to a function from a column name to an aggregate.
    """
    columns = list(columns)
    if not columns:
        return df.limit(0).select(F.lit("").alias("column"), *[F.lit(None).alias(label) for label in measures])
    if len(columns) > COLUMNS_AT_ONCE:  # each aggregation reads its own columns; its code stays small
        chunks = [columns[i:i + COLUMNS_AT_ONCE] for i in range(0, len(columns), COLUMNS_AT_ONCE)]
        return reduce(DataFrame.unionByName, [per_column(df, chunk, measures) for chunk in chunks])
    wide = df.agg(*[
        F.struct(*[make(c).alias(label) for label, make in measures.items()]).alias(f"__{i}")
        for i, c in enumerate(columns)
    ])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"__{i}.{label}").alias(label) for label in measures])
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(entries))


def value_counts(df: DataFrame, columns, cast: str = "string") -> DataFrame:
    """(column, value, n) for all columns with one shuffle; nulls are counted as a value."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value")) for c in columns])
    return df.select(F.inline(entries)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def convertible_text(df: DataFrame, columns=None, share: float = CONVERTIBLE_SHARE) -> DataFrame:
    """Share of rows of each string column that parse as numbers."""
    columns = string_columns(df) if columns is None else columns
    ratio = per_column(df, columns, {
        "ratio": lambda c: F.coalesce(F.avg(to_number(col(c)).isNotNull().cast("double")), F.lit(0.0)),
    })
    return ratio.withColumn("convertible", F.col("ratio") >= share)


def describe_numeric(df: DataFrame, columns=None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, count long, " + ", ".join(
            f"{c} double" for c in ("mean", "std", "min", "max", "q25", "q50", "q75")))
    basic = per_column(df, columns, {
        "count": lambda c: F.count(as_double(df, c)), "mean": lambda c: F.avg(as_double(df, c)),
        "std": lambda c: F.stddev_samp(as_double(df, c)), "min": lambda c: F.min(as_double(df, c)),
        "max": lambda c: F.max(as_double(df, c)),
    })
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")
    )
    return basic.join(quarters, "column", "left")


def describe_categorical(df: DataFrame, columns=None) -> DataFrame:
    """count, unique, top and freq per text column; the smallest value wins a tie."""
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, count long, unique long, top string, freq long")
    some = F.col("value").isNotNull()
    found = value_counts(df, columns).groupBy("column").agg(
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.when(some, F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(some, F.col("n"))).alias("freq"),
    )
    labels = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")  # also those without a row
    return labels.join(found, F.col("name") == F.col("column"), "left").select(
        F.col("name").alias("column"), F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("unique", F.lit(0)).alias("unique"), "top", "freq")


def top_values(df: DataFrame, columns=None, limit: int = 5) -> DataFrame:
    """The most frequent values of each text column; only the local best leave a task."""
    columns = string_columns(df) if columns is None else list(columns)
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        value_counts(df, columns).where(F.col("value").isNotNull())
        .withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)
    )


def kpi_cards(df: DataFrame, totals=None) -> DataFrame:
    """Row count, column count and the totals of the first two numeric columns."""
    totals = numeric_columns(df)[:2] if totals is None else totals
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        *[zero_if_null(F.sum(col(c).cast("double"))).alias(f"total_{c}") for c in totals],
    )


def filter_options(df: DataFrame, column: str) -> DataFrame:
    return (
        df.select(col(column).cast("string").alias("option")).where(F.col("option").isNotNull())
        .distinct().orderBy("option")
    )


def year_like(df: DataFrame) -> DataFrame:
    """Integer columns whose name says year or whose values all lie in a calendar range."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL)]
    low, high = YEAR_RANGE

    def verdict(c: str) -> Column:
        inside = (F.min(col(c)) >= low) & (F.max(col(c)) <= high)
        return F.lit(True) if "year" in c.lower() else F.coalesce(inside, F.lit(False))

    found = per_column(df, whole, {"is_year": verdict})
    return found.withColumn("is_year", F.col("is_year").cast("boolean"))


def filter_domains(df: DataFrame, max_numeric: int | None = None) -> DataFrame:
    """Smallest and largest value of date and numeric columns; constant and year columns are left out."""
    years = {r["column"] for r in year_like(df).where("is_year").collect()}
    dates = [f.name for f in df.schema.fields if is_temporal(f.dataType)]
    numbers = [c for c in numeric_columns(df) if c not in years][:max_numeric]

    def number(pick):
        return lambda c: pick(as_double(df, c)) if c in numbers else F.max(F.lit(None).cast("double"))

    def moment(pick):
        return lambda c: pick(col(c).cast("timestamp_ntz")) if c in dates else F.max(F.lit(None).cast("timestamp_ntz"))

    spans = per_column(df, dates + numbers, {
        "number_low": number(F.min), "number_high": number(F.max),
        "date_low": moment(F.min), "date_high": moment(F.max),
    })
    return spans.where((F.col("number_low") < F.col("number_high")) | (F.col("date_low") < F.col("date_high")))


def _level(df: DataFrame, c: str) -> Column:
    return as_double(df, c) if isinstance(type_of(df, c), (T.FloatType, T.DoubleType)) else col(c)


def cardinality(df: DataFrame, columns=None) -> DataFrame:
    """Distinct non-missing values per column."""
    columns = df.columns if columns is None else list(columns)
    return per_column(df, columns, {"n_distinct": lambda c: F.count_distinct(_level(df, c))})


def varying(df: DataFrame, columns=None) -> list[str]:
    """The columns with more than one non-missing value, without counting them."""
    columns = df.columns if columns is None else list(columns)
    found = per_column(df, columns, {"varies": lambda c: F.min(_level(df, c)) < F.max(_level(df, c))})
    return [r["column"] for r in found.where("varies").collect()]


def cardinality_map(df: DataFrame, columns=None) -> dict[str, int]:
    return {r["column"]: r["n_distinct"] for r in cardinality(df, columns).collect()}
