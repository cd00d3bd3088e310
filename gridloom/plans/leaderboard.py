"""Cross-validated comparison of model candidates, and permutation importance."""

from __future__ import annotations

import hashlib
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, quoted, type_of
from ..functions.hashing import HASH_DIGITS, HASH_RANGE, row_number_hash
from ..operators.metrics import class_metrics, error_metrics, fold_average, ranking_metrics
from ..operators.models import MOST_FITS, ModelSpec, fit_prepared, prepare, training_rows, with_score
from ..operators.split import kfold, stratified_kfold, time_folds
from ..session import checkpointed

LOG = logging.getLogger(__name__)
# What errors of lost machines, not of a model, say.
INFRASTRUCTURE = ("ExecutorLostFailure", "OutOfMemoryError", "No space left", "SparkContext was shut down", "FetchFailed")
SCORE_SCHEMA = "model string, fold int, metric string, value double"
BUCKET_ROWS = 50_000
TOP_IMPORTANCES = 15


def assign_folds(df: DataFrame, label: str, task: str, key, folds: int, time: str | None = None) -> DataFrame:
    """Add ``fold``; with a time column, fold i is tested after training on everything earlier."""
    if time:
        return time_folds(df, time, key, folds).withColumn("fold", F.col("block") - 1).drop("block")
    if task == "classification":
        return stratified_kfold(df, label, key, folds)
    return kfold(df, key, folds)


def fold_scores(predictions: DataFrame, task: str, classes: int) -> list[tuple]:
    """(fold, metric, value) of predictions (fold, label, prediction, score) of one model."""
    if task == "regression":
        found = {r["fold"]: r.asDict() for r in error_metrics(predictions, "label", "prediction", ["fold"]).collect()}
    else:
        kept = predictions.select(
            "fold", F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"), "score")
        found = {r["fold"]: r.asDict() for r in class_metrics(kept, "actual", "predicted", ["fold"], positive=1).collect()}
        if classes <= 2 and not kept.where("score is not null").isEmpty():
            for fold in found:
                ranks = ranking_metrics(kept.where(F.col("fold") == fold), "actual", "score").first().asDict()
                found[fold].update(ranks)
    return [(fold, m, float(v)) for fold, row in found.items() for m, v in row.items() if v is not None and m not in ("n", "fold")]


@dataclass(frozen=True)
class EncodedFold:
    """Training and test rows (features, label) of a fold under the encoder fitted on its training rows."""

    fold: int
    train: DataFrame
    test: DataFrame
    size: int


def encoded_folds(folded: DataFrame, features, label: str, folds: int, ordered: bool = False) -> list[EncodedFold]:
    """Every fold encoded and written once, for all models; folds side by side, as most of the steps are small jobs."""
    def one(fold: int) -> EncodedFold:
        train = folded.where((F.col("fold") < fold) if ordered else (F.col("fold") != fold))
        test = folded.where(F.col("fold") == fold)
        encoder, rows, size = prepare(train, features, label)
        if encoder is not None:
            test = encoder.transform(test)
        return EncodedFold(fold, rows, training_rows(test.withColumn("label", col(label).cast("double"))), size)

    with ThreadPoolExecutor(max_workers=min(MOST_FITS, max(1, folds))) as pool:
        return list(pool.map(one, range(folds)))


def validate(encoded: list[EncodedFold], spec: ModelSpec, classes: int, **params) -> list[tuple]:
    """(model, fold, metric, value) for every fold; the model is fitted anew for each."""
    models = fit_prepared(spec, [e.train for e in encoded], [e.size for e in encoded], classes, params)

    def score(model: PipelineModel, e: EncodedFold) -> DataFrame:
        return with_score(model.transform(e.test)).select(F.lit(e.fold).alias("fold"), "label", "prediction", "score")

    with ThreadPoolExecutor(max_workers=min(MOST_FITS, max(1, len(encoded)))) as pool:  # neighbours search right here
        scored = list(pool.map(score, models, encoded))
    predictions = checkpointed(reduce(DataFrame.unionByName, scored))
    return [(spec.name, *row) for row in fold_scores(predictions, spec.task, classes)]


def cross_validate(folded: DataFrame, spec: ModelSpec, features, label: str, classes: int, folds: int,
                   ordered: bool = False, **params) -> list[tuple]:
    """(model, fold, metric, value) for every fold; encoder and model are refitted each time."""
    return validate(encoded_folds(folded, features, label, folds, ordered), spec, classes, **params)


def leaderboard(df: DataFrame, specs, features, label: str, key, classes: int = 0, folds: int = 3,
                time: str | None = None, parallel: int = 4, params: dict | None = None) -> DataFrame:
    """Mean metrics of every candidate, best first, with its place.

    Classes rank by roc_auc, else f1, else accuracy; numbers by the smallest rmse. A candidate that cannot
    be fitted on this table comes last with its ``error``; a lost executor or a full memory or disk is raised.
    """
    specs, params = list(specs), params or {}
    task = specs[0].task
    wanted = [c for c in dict.fromkeys([*(features or ["features"]), label, *key, *([time] if time else [])])]
    folded = checkpointed(assign_folds(df.select(*[col(c) for c in wanted]), label, task, key, folds, time))
    encoded = encoded_folds(folded, features, label, folds, bool(time))

    errors: dict[str, str] = {}

    def attempt(spec: ModelSpec) -> list[tuple]:
        try:
            return validate(encoded, spec, classes, **params.get(spec.name, {}))
        except Exception as error:  # a model that cannot handle this table must not end the comparison
            if any(sign in str(error) for sign in INFRASTRUCTURE):
                raise
            LOG.warning("%s failed: %s", spec.name, error)
            errors[spec.name] = str(error)[:500]
            return []

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = [row for found in pool.map(attempt, specs) for row in found]
    names = ["roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy"] if task == "classification" else \
        ["rmse", "mae", "r2", "mape"]
    means = fold_average(df.sparkSession.createDataFrame(rows, SCORE_SCHEMA), ["model", "metric"], "value")
    table = means.groupBy("model").pivot("metric", names).agg(F.first("value"))
    entered = df.sparkSession.createDataFrame([(s.name, errors.get(s.name)) for s in specs], "model string, error string")
    table = entered.join(table, "model", "left").select("model", *names, "error")
    first = F.coalesce("roc_auc", "f1", "accuracy").desc_nulls_last() if task == "classification" else F.col("rmse").asc_nulls_last()
    place = F.row_number().over(Window.orderBy(first, "model"))  # a handful of models
    return table.withColumn("place", place).orderBy("place")


def hash_places(df: DataFrame, key, seed: int) -> tuple[DataFrame, int]:
    """(rows with ``__place``, their number): places 0 to n - 1 in the order of a hash of the key, then the key.

    Hashes are uniform, so ranges of them are about equal; a range is sorted by itself behind the counts before it.
    """
    shared = checkpointed(df.withColumn("__hash", row_number_hash(key, seed)))
    n = shared.count()
    step = -(-HASH_RANGE // max(1, -(-n // BUCKET_ROWS)))
    ranged = shared.withColumn("__range", F.floor(F.col("__hash") / F.lit(step)).cast("long"))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per 50,000 rows
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__hash", *[col(k) for k in key])) - 1
    placed = ranged.withColumn("__inside", inside).join(offsets, "__range")
    return placed.select(*[col(c) for c in df.columns], (F.col("__before") + F.col("__inside")).alias("__place")), n


def turn(feature: str, repeat: int, rows: int, seed: int) -> int:
    """By how many places a trial moves its feature: 1 to rows - 1, from the leading digits of an md5."""
    digest = hashlib.md5(f"{seed}-{feature}-{repeat}".encode()).hexdigest()
    return 1 + int(digest[:HASH_DIGITS], 16) % (rows - 1) if rows > 1 else 0


def permuted(df: DataFrame, features, key, repeats: int, seed: int = 42) -> DataFrame:
    """One copy of the rows per (feature, repeat), with that feature taken from another random row.

    Rows stand in hash order of their key, in a circle; a trial takes every value of its feature from the row a
    drawn number of places further on. Rows are shuffled once, and per trial only the one value that moves.
    """
    features = list(features)
    placed, n = hash_places(df, key, seed)
    placed = checkpointed(placed)
    trials = [(f, r) for f in features for r in range(repeats)]
    kinds = {f: type_of(df, f) for f in features}
    moves = F.array(*[
        F.struct(
            F.pmod(F.col("__place") - F.lit(turn(f, r, n, seed)), F.lit(max(1, n))).alias("__to"), F.lit(f).alias("feature"),
            F.lit(r).alias("repeat"),
            *[(col(o) if o == f else F.lit(None).cast(kinds[o])).alias(f"__t{i}") for i, o in enumerate(features)])
        for f, r in trials
    ])
    taken = placed.select(F.inline(moves))
    joined = placed.join(taken, F.col("__place") == F.col("__to"))
    return joined.select(
        "feature", "repeat", *[placed[quoted(c)] for c in df.columns if c not in features],
        *[F.when(F.col("feature") == f, F.col(f"__t{i}")).otherwise(placed[quoted(f)]).alias(f) for i, f in enumerate(features)],
    )


def permutation_importance(model: PipelineModel, df: DataFrame, features, label: str, key, task: str,
                           repeats: int = 5, top: int = TOP_IMPORTANCES, seed: int = 42) -> DataFrame:
    """Mean drop of accuracy (or r2) when one feature is shuffled: a single scoring job for all trials."""
    kept = df.select(*[col(c) for c in dict.fromkeys([*features, label, *key])])

    def quality(predictions: DataFrame, by) -> DataFrame:
        if task == "classification":
            right = (F.col("prediction") == col(label).cast("double")).cast("double")
            return predictions.groupBy(*by).agg(F.avg(right).alias("quality"))
        return error_metrics(predictions, label, "prediction", by).select(*by, F.col("r2").alias("quality"))

    base = quality(model.transform(kept), []).first()["quality"]
    shuffled = quality(model.transform(permuted(kept, list(features), key, repeats, seed)), ["feature", "repeat"])
    return shuffled.groupBy("feature").agg(
        (F.lit(base) - F.avg("quality")).alias("importance"), F.stddev_pop("quality").alias("deviation")
    ).orderBy(F.desc("importance"), "feature").limit(top)
