"""Target and task inference, imbalance, skew and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FRACTIONAL, as_double, col, is_numeric, numeric_columns, type_of
from .diagnose import _empty_pairs, _pair_correlation
from .information import mutual_information
from .profile import cardinality_map, per_column, varying
from .roles import model_roles

CLASS_LIMIT = 20
IMBALANCE_THRESHOLD = 0.2
SKEW_THRESHOLD = 1.0
LEAK_CORRELATION = 0.9
LEAK_TOP = 5
OVERRIDE_LEVELS = 50
OVERRIDE_SHARE = 0.25


def infer_target(df: DataFrame, hint: str | None = None) -> str | None:
    """The hinted column, else the last one that is no identifier and varies; alone it is ambiguous."""
    if hint and hint in df.columns:
        return hint
    several = set(varying(df))
    usable = [c for c in reversed(df.columns) if c in several and "id" not in c.lower()]
    return usable[0] if len(usable) > 1 else None


def infer_task(df: DataFrame, target: str, class_limit: int = CLASS_LIMIT) -> str:
    """Numbers with many values are regressed, everything else is classified."""
    if not is_numeric(type_of(df, target)):
        return "classification"
    return "classification" if cardinality_map(df, [target])[target] <= class_limit else "regression"


def _size_and_levels(df: DataFrame, target: str) -> tuple[int, int]:
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(target)).alias("d")).first()
    return found["n"], found["d"]


def effective_task(df: DataFrame, target: str, task: str = "classification") -> str:
    """Classification of a fractional or many-valued number becomes regression."""
    dtype = type_of(df, target)
    if task != "classification" or not is_numeric(dtype):
        return task
    if isinstance(dtype, FRACTIONAL):
        return "regression"
    rows, levels = _size_and_levels(df, target)
    return "regression" if levels > max(20, 0.1 * rows) else task


def override_task(df: DataFrame, target: str, task: str = "classification") -> str:
    """A class target whose values hardly repeat is regressed instead."""
    if task != "classification":
        return task
    rows, levels = _size_and_levels(df, target)
    return "regression" if levels > OVERRIDE_LEVELS and levels / max(rows, 1) > OVERRIDE_SHARE else task


def class_imbalance(df: DataFrame, target: str, threshold: float = IMBALANCE_THRESHOLD) -> DataFrame:
    """Rows per class with the share of the smallest class and whether it is too small."""
    counts = (
        df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ratio = counts.agg(F.min("n") / F.sum("n")).scalar()
    return counts.select("class", "n", ratio.alias("ratio")).withColumn("is_imbalanced", F.col("ratio") < threshold)


def skewness(df: DataFrame, columns=None) -> DataFrame:
    """Bias-corrected skewness per numeric column: null below three values, 0 without variance."""
    columns = numeric_columns(df) if columns is None else list(columns)
    n, spread, raw = F.col("n"), F.col("spread"), F.col("raw")
    corrected = F.when(n < 3, None).when(spread == 0, 0.0).otherwise(raw * F.sqrt(n * (n - 1)) / (n - 2))
    found = per_column(df, columns, {
        "n": lambda c: F.count(as_double(df, c)).cast("double"),
        "spread": lambda c: F.var_pop(as_double(df, c)),
        "raw": lambda c: F.skewness(as_double(df, c)),
    })
    return found.select("column", corrected.alias("skew"))


def skew_report(df: DataFrame, columns=None, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    return skewness(df, columns).where(F.abs("skew") >= threshold)


def leakage_numeric(df: DataFrame, target: str, columns=None, threshold: float = LEAK_CORRELATION) -> DataFrame:
    """Features whose absolute correlation with a numeric target is suspiciously high."""
    columns = [c for c in (numeric_columns(df) if columns is None else columns) if c != target]
    if not columns:
        return _empty_pairs(df).select(F.col("column_a").alias("feature"), F.col("value").alias("score"))
    found = _pair_correlation(df, [(c, target) for c in columns])
    return found.select(F.col("column_a").alias("feature"), F.col("value").alias("score")).where(
        F.col("score") >= threshold
    ).orderBy(F.desc("score"), "feature")


def leakage_category(df: DataFrame, target: str, columns=None, top: int = LEAK_TOP) -> DataFrame:
    """Features that tell most about a class target."""
    roles = model_roles(df)
    columns = roles.numeric + roles.categorical if columns is None else list(columns)
    return mutual_information(df, columns, target).orderBy(F.desc("score"), "feature").limit(top)


def leakage(df: DataFrame, target: str) -> DataFrame:
    return leakage_numeric(df, target) if is_numeric(type_of(df, target)) else leakage_category(df, target)
