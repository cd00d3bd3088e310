"""Quality of predictions, overall and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .aggregate import pivot_cross
from .order import range_splits, running_totals

CLASS_GAP = 0.1
ERROR_GAP_SHARE = 0.2
MAX_CLASSES = 1000


def confusion_counts(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """Rows per (group, actual, predicted), labels as text."""
    return df.groupBy(
        *[col(b) for b in by], col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str, by=(), positive=None) -> DataFrame:
    """f1, precision, recall, accuracy and n, overall or per group.

    With at most two true classes overall, the scores are those of the positive class (the larger
    label unless given); otherwise classes are averaged by support. Empty denominators give 0.
    """
    by = list(by)
    cells = confusion_counts(df, actual, predicted, by)
    hit = F.col("actual").eqNullSafe(F.col("predicted"))
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"),
                 F.when(hit, F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("hits")),
    )))
    per_class = sides.groupBy(*by, "label").agg(
        F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("said")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("true")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("true") + F.col("said")), zero)
    scored = per_class.select("*", precision.alias("p"), recall.alias("r"), f1.alias("f"))

    truth = cells.where(F.col("actual").isNotNull()).agg(
        F.struct(F.count_distinct("actual").alias("k"), F.max("actual").alias("last")).alias("s")
    ).scalar()
    if positive is not None:
        chosen = F.lit(str(positive))
    else:
        chosen = F.when(truth["k"] == 2, truth["last"]).otherwise(F.lit("1"))
    binary = truth["k"] <= 2

    def score(name: str) -> Column:
        of_positive = F.coalesce(F.max(F.when(F.col("label") == F.col("__positive"), F.col(name))), zero)
        weighted = F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("true")), F.sum("true")), zero)
        return F.when(F.first("__binary"), of_positive).otherwise(weighted)

    flagged = scored.withColumn("__binary", binary).withColumn("__positive", chosen)
    return flagged.groupBy(*[col(b) for b in by]).agg(
        score("f").alias("f1"), score("p").alias("precision"), score("r").alias("recall"),
        (F.sum("hits") / F.sum("true")).alias("accuracy"), F.sum("true").alias("n"),
    )


def ranking_metrics(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """ROC AUC (ties count half) and average precision of a binary score; null with one class."""
    hit = (col(actual).cast("string") == F.lit(str(positive))).cast("long")
    # Adding 0.0 folds the negative zero into zero, so equal scores meet.
    rows = df.select((col(score).cast("double") + 0.0).alias("score"), hit.alias("pos"), (1 - hit).alias("neg"))
    counted = rows.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = running_totals(counted, "score", ["pos", "neg"], splits=range_splits(rows, "score"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    from_pos, from_neg = F.col("all_pos") - F.col("below_pos"), F.col("all_neg") - F.col("below_neg")
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    both = pairs > 0
    return ranked.agg(
        F.when(both, F.sum(pos * (F.col("below_neg") + neg / 2)) / pairs).alias("roc_auc"),
        F.when(both, F.sum(F.try_divide(pos, F.col("all_pos")) * (from_pos / (from_pos + from_neg)))).alias("pr_auc"),
    )


def error_metrics(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """rmse, mae, r2, mape (denominators floored) and n, from one aggregation."""
    y, gap = col(actual).cast("double"), col(actual).cast("double") - col(predicted).cast("double")
    sums = df.groupBy(*[col(b) for b in by]).agg(
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop(y).alias("var"),
        (F.avg(F.abs(gap) / F.greatest(F.abs(y), F.lit(1e-8))) * 100).alias("mape"), F.count(gap).alias("n"),
    )
    fit = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(*[col(b) for b in by], F.sqrt("mse").alias("rmse"), "mae", fit.alias("r2"), "mape", "n")


def fold_average(scores: DataFrame, by, value: str) -> DataFrame:
    """Mean over the finite values of each group; a group without any is left out."""
    finite = col(value).isNotNull() & ~F.isnan(col(value)) & (F.abs(col(value)) != float("inf"))
    return scores.where(finite).groupBy(*[col(b) for b in by]).agg(F.avg(col(value)).alias(value))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes=None) -> DataFrame:
    """One row per actual class, one column per predicted class, zeros included.

    Without ``classes`` all labels of both columns are. A label outside given classes raises; a missing one does
    not count. The matrix has a column per class; ``confusion_counts`` is the long form without a limit.
    """
    counts = confusion_counts(df, actual, predicted).where("actual is not null and predicted is not null")
    found = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
    found = sorted(r["c"] for r in found)
    classes = found if classes is None else [str(c) for c in classes]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes; too many for a matrix")
    if not set(found) <= set(classes):
        raise ValueError(f"labels outside the classes: {sorted(set(found) - set(classes))[:10]}")
    table = pivot_cross(counts.withColumnRenamed("n", "__n"),
                        "actual", "predicted", "__n", "sum", levels=classes)
    every = df.sparkSession.createDataFrame([(c,) for c in classes], "actual string")
    filled = every.join(table, "actual", "left")
    return filled.select("actual", *[F.coalesce(col(c), F.lit(0)).cast("long").alias(c) for c in classes])


def prediction_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Actual against predicted, every row."""
    return df.select(col(actual).alias("actual"), col(predicted).alias("predicted"))


def group_class_metrics(df: DataFrame, actual: str, predicted: str, group: str) -> DataFrame:
    """f1, accuracy and n per group; the class count over all rows decides how classes are averaged."""
    return class_metrics(df, actual, predicted, by=[group]).where(col(group).isNotNull()).select(
        col(group), "f1", "accuracy", "n"
    )


def group_error_metrics(df: DataFrame, actual: str, predicted: str, group: str) -> DataFrame:
    return error_metrics(df, actual, predicted, by=[group]).where(col(group).isNotNull()).select(col(group), "rmse", "n")


def disparity(groups: DataFrame, metric: str, max_gap: float) -> DataFrame:
    """Spread of a metric over the groups, and whether it exceeds the allowed gap."""
    gap = F.max(col(metric)) - F.min(col(metric))
    return groups.agg(gap.alias("gap")).select(
        F.lit(metric).alias("metric"), "gap", F.lit(float(max_gap)).alias("max_gap"),
        (F.col("gap") > max_gap).alias("alert"),
    )
