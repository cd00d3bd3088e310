"""Feature scores and their combination: long tables of (feature, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col
from ..session import checkpointed
from .forest import RandomForest
from .information import mutual_information
from .models import training_rows
from .prepare import encode_target, ordinal_encode
from .profile import per_column

TOP_FEATURES = 20
LASSO_ALPHA = 0.001
RANK_TREES = 100
MAX_DEPTH = 30  # as deep as Spark's forests go


def variance_scores(df: DataFrame, columns) -> DataFrame:
    """Population variance per numeric column."""
    found = per_column(df, columns, {"score": lambda c: F.var_pop(as_double(df, c))})
    return found.select(F.col("column").alias("feature"), "score")


def variance_filter(df: DataFrame, columns, threshold: float) -> DataFrame:
    """Scores are only reported for a positive threshold."""
    return variance_scores(df, columns).where(F.lit(threshold > 0))


def information_scores(df: DataFrame, columns, target: str) -> DataFrame:
    """Mutual information with a class or a quantile-binned numeric target."""
    return mutual_information(df, columns, target)


def chi2_scores(df: DataFrame, columns, target: str) -> DataFrame:
    """Chi-square of per-class feature sums against class shares; negative values count as 0."""
    columns = list(columns)
    sums = df.groupBy(col(target).alias("__class")).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(F.greatest(as_double(df, c), F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    sums = checkpointed(sums)
    total = sums.agg(F.sum("__n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(columns))]).first()
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("o"),
                 (F.col("__n") / F.lit(total["n"]) * F.lit(total[f"s{i}"])).alias("e")) for i, c in enumerate(columns)])
    part = F.try_divide((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")), F.col("e"))
    return sums.select(F.inline(entries)).groupBy("feature").agg(F.sum(part).alias("score"))


def _assembled(df: DataFrame, columns, target: str, task: str) -> DataFrame:
    """Encoded features as a vector and the target as a number."""
    rows = df.where(col(target).isNotNull())
    if task == "classification":
        rows = encode_target(rows, target).withColumn("label", F.col(f"{target}_code").cast("double"))
    else:
        rows = rows.withColumn("label", as_double(rows, target))
    plain = rows.select(*[col(c) for c in columns], "label")
    encoded = ordinal_encode(plain, columns)
    return training_rows(VectorAssembler(inputCols=list(columns), outputCol="features").transform(encoded))


def _scores(df: DataFrame, columns, values) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, values)], "feature string, score double"
    )


def l1_scores(df: DataFrame, columns, target: str, task: str) -> DataFrame:
    """Absolute coefficients of an L1-penalized linear model."""
    rows = _assembled(df, columns, target, task)
    if task == "classification":
        model = LogisticRegression(
            elasticNetParam=1.0, regParam=1.0 / max(rows.count(), 1), standardization=False, maxIter=2000, tol=1e-3
        ).fit(rows)
        weights = abs(model.coefficientMatrix.toArray()[0])
    else:
        model = LinearRegression(
            elasticNetParam=1.0, regParam=LASSO_ALPHA, standardization=False, maxIter=5000, tol=1e-3
        ).fit(rows)
        weights = abs(model.coefficients.toArray())
    return _scores(df, columns, weights)


def tree_scores(df: DataFrame, columns, target: str, task: str, trees: int = RANK_TREES, depth: int = MAX_DEPTH) -> DataFrame:
    """Importances of a random forest."""
    rows = _assembled(df, columns, target, task)
    classes = int(rows.agg(F.max("label")).first()[0] or 0) + 1 if task == "classification" else 0
    model = RandomForest(numClasses=max(2, classes) if classes else 0, numTrees=trees, maxDepth=depth, seed=42).fit(rows)
    return _scores(df, columns, model.featureImportances.toArray())


def embedded_scores(df: DataFrame, columns, target: str, task: str, **tree) -> list[DataFrame]:
    """L1 and forest scores; a target that cannot be classified is regressed."""
    if task == "classification":
        try:
            return [l1_scores(df, columns, target, task), tree_scores(df, columns, target, task, **tree)]
        except ValueError:
            task = "regression"
    return [l1_scores(df, columns, target, task), tree_scores(df, columns, target, task, **tree)]


def unify(tables, top: int = TOP_FEATURES) -> DataFrame:
    """Mean raw score of each feature over the methods, best first."""
    together = reduce(DataFrame.unionByName, tables)
    return together.groupBy("feature").agg(F.avg("score").alias("importance")).orderBy(
        F.desc("importance"), "feature"
    ).limit(top)
