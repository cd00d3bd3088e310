"""The full diagnosis report and the understanding summary as one long table each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diagnose import (
    association_pairs, correlation_pairs, duplicate_report, missing_report, outlier_report,
)
from ..operators.profile import convertible_text
from ..operators.roles import model_roles
from ..operators.understand import (
    class_imbalance, infer_target, infer_task, leakage, skew_report,
)


def _rows(df: DataFrame, section: str, item, measure: str, value) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), item.alias("item"), F.lit(measure).alias("measure"),
        value.cast("double").alias("value"),
    )


def _all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def diagnose(df: DataFrame, numeric=None, categorical=None) -> DataFrame:
    """Missing values, duplicates, outliers, correlated and associated pairs: (section, item, measure, value)."""
    roles = model_roles(df)
    numeric = roles.numeric if numeric is None else list(numeric)
    categorical = roles.categorical if categorical is None else list(categorical)
    item = F.col("column")
    missing, duplicates, outliers = missing_report(df), duplicate_report(df), outlier_report(df, numeric)
    pair = F.concat_ws(" / ", "column_a", "column_b")
    return _all([
        _rows(missing, "missing", item, "count", F.col("missing_count")),
        _rows(missing, "missing", item, "percent", F.col("missing_pct")),
        _rows(duplicates, "duplicates", F.lit("rows"), "count", F.col("duplicate_count")),
        _rows(duplicates, "duplicates", F.lit("rows"), "ratio", F.col("duplicate_ratio")),
        _rows(outliers, "outliers", item, "lower", F.col("lower")),
        _rows(outliers, "outliers", item, "upper", F.col("upper")),
        _rows(outliers, "outliers", item, "count", F.col("outlier_count")),
        _rows(outliers, "outliers", item, "percent", F.col("outlier_pct")),
        _rows(correlation_pairs(df, numeric), "correlation", pair, "abs_r", F.col("value")),
        _rows(association_pairs(df, categorical), "association", pair, "cramers_v", F.col("value")),
    ])


def understand(df: DataFrame, hint: str | None = None) -> DataFrame:
    """Column roles, target, task, imbalance, skew and leakage: (section, item, measure, value)."""
    spark, roles = df.sparkSession, model_roles(df)
    facts = [("role", c, kind, 1.0) for kind in ("numeric", "categorical", "datetime", "boolean")
             for c in getattr(roles, kind)]
    target = infer_target(df, hint)
    task = infer_task(df, target) if target else None
    if target:
        facts += [("target", target, "chosen", 1.0), ("task", task, "chosen", 1.0)]
    parts = [spark.createDataFrame(facts, "section string, item string, measure string, value double")]
    if roles.categorical:
        text = convertible_text(df, roles.categorical).where("convertible")
        parts.append(_rows(text, "convertible", F.col("column"), "ratio", F.col("ratio")))
    if not target:
        return _all(parts)
    if task == "classification":
        classes = class_imbalance(df, target)
        parts += [
            _rows(classes, "imbalance", F.col("class"), "count", F.col("n")),
            _rows(classes.limit(1), "imbalance", F.lit(target), "min_share", F.col("ratio")),
        ]
    if roles.numeric:
        parts.append(_rows(skew_report(df, roles.numeric), "skew", F.col("column"), "skewness", F.col("skew")))
    parts.append(_rows(leakage(df, target), "leakage", F.col("feature"), "score", F.col("score")))
    return _all(parts)
