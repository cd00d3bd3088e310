"""Cleaning steps: coercion, missing values, outliers, duplicates, uninformative columns."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    as_double, col, is_missing, is_temporal, nan_as_null, to_flag, to_moment, to_number, type_of,
)
from .diagnose import iqr_bounds
from .neighbors import BLOCK_ROWS, nearest_neighbors
from .order import quantile_map
from .profile import per_column, value_counts

FILL_TEXT = "Unknown"
MAX_TOP_SHARE = 0.95
HASH_BUCKETS = 1024
# Text layouts of a general timestamp, unambiguous ones first, then month first.
GENERAL_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "M/d/yyyy", "M-d-yyyy", "M/d/yyyy H:m:s",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
)


def replaced(df: DataFrame, columns: dict) -> DataFrame:
    """Swap columns for new expressions, keeping their order."""
    return df.select(*[columns[c].alias(c) if c in columns else col(c) for c in df.columns])


def coerce(df: DataFrame, to_numeric=(), to_datetime=(), to_bool=()) -> DataFrame:
    """Text to numbers, timestamps or booleans; what does not fit becomes null."""
    new = {}
    for c in to_numeric:
        text = isinstance(type_of(df, c), T.StringType)
        new[c] = to_number(col(c)) if text else col(c).cast("double")
    for c in to_datetime:
        new[c] = col(c).cast("timestamp_ntz") if is_temporal(type_of(df, c)) else to_moment(col(c), GENERAL_FORMATS)
    for c in to_bool:
        new[c] = to_flag(col(c))
    return replaced(df, new)


def add_missing_indicators(df: DataFrame, columns) -> DataFrame:
    """``<column>_missing`` as 0/1 for each column that exists."""
    flags = [is_missing(df, c).cast("int").alias(f"{c}_missing") for c in columns if c in df.columns]
    return df.select(*[col(c) for c in df.columns], *flags)


def fill_values(df: DataFrame, columns, strategy: str) -> dict[str, float | None]:
    if strategy == "median":
        return {c: q[0] if q else None for c, q in quantile_map(df, columns, [0.5]).items()}
    if strategy == "mean":
        found = df.agg(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: found[f"m{i}"] for i, c in enumerate(columns)}
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(df: DataFrame, columns, strategy: str = "median") -> DataFrame:
    """Missing numbers become the median or mean; filled columns are doubles."""
    columns = list(columns)
    if not columns:
        return df
    values = fill_values(df, columns, strategy)
    return replaced(df, {c: F.coalesce(as_double(df, c), F.lit(values[c]).cast("double")) for c in columns})


def impute_neighbors(df: DataFrame, columns, key: str, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Missing numbers become the mean of the k nearest rows that have the column.

    Distance uses the columns two rows share; a row that shares none gets the column mean.
    """
    columns = list(columns)
    rows = df.select(col(key).cast("long").alias("__key"), F.array(*[as_double(df, c) for c in columns]).alias("__v"))
    holes = df.agg(*[F.count_if(is_missing(df, c)).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    targets = [i for i in range(len(columns)) if holes[f"h{i}"]]
    means = fill_values(df, columns, "mean") if targets else {}
    out, new = df, {}
    for i in targets:
        lacking = rows.where(F.col("__v")[i].isNull())
        donors = rows.where(F.col("__v")[i].isNotNull()).withColumn("__given", F.col("__v")[i])
        near = nearest_neighbors(lacking, "__key", donors, "__key", "__v", k, block_rows, payload="__given")
        fills = near.groupBy("__key").agg(F.avg("payload").alias(f"__fill{i}"))
        out = out.join(fills, out[f"`{key}`"].cast("long") == fills["__key"], "left").drop("__key")
        new[columns[i]] = F.coalesce(as_double(df, columns[i]), F.col(f"__fill{i}"), F.lit(means[columns[i]]).cast("double"))
    return replaced(out, new).select(*[col(c) for c in df.columns])


def fill_text(df: DataFrame, columns, value: str = FILL_TEXT) -> DataFrame:
    return replaced(df, {c: F.coalesce(col(c).cast("string"), F.lit(value)) for c in columns})


def cap_outliers(df: DataFrame, columns, reach: float = 1.5) -> DataFrame:
    """Clip to the fences of each column; null stays null."""
    return cap_to(df, iqr_bounds(df, list(columns), reach))


def cap_to(df: DataFrame, bounds: dict) -> DataFrame:
    return replaced(df, {
        c: F.when(as_double(df, c).isNotNull(), F.least(F.greatest(as_double(df, c), F.lit(lo)), F.lit(hi)))
        for c, (lo, hi) in bounds.items()
    })


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one level, null counted as a level: one narrow pass over extremes."""
    if not df.columns:
        return []
    level = {f.name: nan_as_null(col(f.name), f.dataType) for f in df.schema.fields}
    found = per_column(df, df.columns, {
        "missing": lambda c: F.count_if(level[c].isNull()),
        "present": lambda c: F.count(level[c]),
        "one": lambda c: F.coalesce(F.min(level[c]) == F.max(level[c]), F.lit(True)),
    }).collect()
    flat = {r["column"] for r in found if r["one"] and (not r["missing"] or not r["present"])}
    return [c for c in df.columns if c in flat]


def sparse_columns(df: DataFrame, columns=None, max_top_share: float = MAX_TOP_SHARE) -> list[str]:
    """Columns whose most frequent value, null included, reaches the share.

    Counting by hash bucket first rules out most columns without shuffling their values.
    """
    columns = df.columns if columns is None else list(columns)
    rows = df.count()
    if not columns or not rows:
        return []
    level = {c: nan_as_null(col(c), type_of(df, c)).cast("string") for c in columns}
    slots = F.array(*[
        F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(level[c]), F.lit(HASH_BUCKETS)).alias("slot"))
        for i, c in enumerate(columns)
    ])
    fullest = (
        df.select(F.inline(slots)).groupBy("i", "slot").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("i").agg(F.max("n").alias("n")).collect()
    )
    candidates = [columns[r["i"]] for r in fullest if r["n"] >= max_top_share * rows]
    if not candidates:
        return []
    plain = df.select(*[level[c].alias(c) for c in candidates])
    tops = value_counts(plain, candidates).groupBy("column").agg(F.max("n").alias("n")).collect()
    sparse = {r["column"] for r in tops if r["n"] >= max_top_share * rows}
    return [c for c in columns if c in sparse]


def drop_columns(df: DataFrame, names) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def drop_constant(df: DataFrame) -> DataFrame:
    return drop_columns(df, constant_columns(df))


def drop_sparse(df: DataFrame, max_top_share: float = MAX_TOP_SHARE) -> DataFrame:
    return drop_columns(df, sparse_columns(df, max_top_share=max_top_share))
