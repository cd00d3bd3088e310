"""Model candidates as Spark ML stages, and fitted models that can be saved and applied."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import checkpointed
from .attach import attach
from .boosting import BoostedTrees
from .forest import RandomForest
from .kernel import KernelMachine
from .neighbors import BLOCK_ROWS, nearest_neighbors
from .network import NeuralNetwork
from .prepare import feature_encoder

SEED = 42
ROWS_PER_TASK = 10_000
MOST_FITS = 4  # of one model side by side
NEAR_PAIRS = 1 << 36  # coordinate differences up to which neighbours are found without an index
FOREST_DEPTH = 30  # as deep as Spark's forests go
SMALL_ROWS, WIDE_FEATURES, VERY_WIDE_FEATURES = 1000, 200, 500


class _NeighborParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "classes, or 0 to average the label", TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "rows per block and chunk", TypeConverters.toInt)

    def _start(self, given: dict):
        self._setDefault(featuresCol="features", labelCol="label", k=5, numClasses=0, blockRows=BLOCK_ROWS)
        self._set(**{k: v for k, v in given.items() if v is not None})


class NearestNeighbors(Estimator, _NeighborParams):
    """k-nearest-neighbour classifier or regressor; fitting numbers the training rows and stores them."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, k=None, numClasses=None, blockRows=None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "NearestNeighborsModel":
        rows = checkpointed(df.select(
            F.monotonically_increasing_id().alias("point"),
            vector_to_array(col(self.getOrDefault(self.featuresCol))).alias("vector"),
            col(self.getOrDefault(self.labelCol)).cast("double").alias("label"),
        ))
        model = NearestNeighborsModel(rows)
        return self._copyValues(model)


class NearestNeighborsModel(Model, _NeighborParams, MLWritable, MLReadable):
    def __init__(self, rows: DataFrame | None = None):
        super().__init__()
        self._start({})
        self.rows = rows

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (and ``probability`` for classes). Equal feature vectors share one search, and of equal
        points only the first k are searched: among equal distances the smaller point wins."""
        keyed = df.withColumn("__vector", vector_to_array(col(self.getOrDefault(self.featuresCol))))
        distinct = keyed.groupBy("__vector").agg(F.count(F.lit(1)).alias("__rows"))
        queries = checkpointed(distinct.withColumn("__row", F.monotonically_increasing_id()))
        k = self.getOrDefault(self.k)
        points = self.rows.withColumnsRenamed({"point": "__row", "vector": "__vector"})
        # Spark drops rows past the k-th in every task before it shuffles, so equal vectors make no hot key.
        place = F.row_number().over(Window.partitionBy("__vector").orderBy("__row"))
        points = checkpointed(points.withColumn("__place", place).where(F.col("__place") <= k).drop("__place"))
        near = nearest_neighbors(
            queries, "__row", points, "__row", "__vector", k, self.getOrDefault(self.blockRows), payload="label",
            all_pairs=NEAR_PAIRS,
        )
        classes = self.getOrDefault(self.numClasses)
        shares = [F.avg((F.col("payload") == c).cast("double")) for c in range(classes)]
        answer = F.array(*shares) if classes else F.avg("payload")
        answers = near.groupBy("__row").agg(answer.alias("__answer")).join(queries, "__row").drop("__row")
        # Equal vectors make hot keys, which the statistics join spreads.
        answered = attach(keyed, answers, ["__vector"], rows="__rows").drop("__vector", "__rows")
        if not classes:
            return answered.withColumnRenamed("__answer", "prediction")
        best = F.array_position("__answer", F.array_max("__answer")) - 1
        return answered.withColumns(
            {"probability": array_to_vector("__answer"), "prediction": best.cast("double")}).drop("__answer")

    def write(self):
        return _NeighborsWriter(self)

    @classmethod
    def read(cls):
        return _NeighborsReader(cls)


class _NeighborsWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active())
        self.model.rows.write.parquet(f"{path}/rows")


class _NeighborsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = NearestNeighborsModel(spark.read.parquet(f"{path}/rows"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _scaled(*stages):
    return [StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), *stages]


def _binary_or_rest(estimator, classes: int):
    return estimator if classes <= 2 else OneVsRest(classifier=estimator)


@dataclass(frozen=True)
class ModelSpec:
    """``stages`` builds the ML stages from (feature count, class count, parameter overrides)."""

    name: str
    task: str
    stages: Callable


CLASSIFIERS = {s.name: s for s in (
    ModelSpec("log_reg", "classification", lambda d, k, p: _scaled(
        LogisticRegression(featuresCol="scaled", **{"maxIter": 1000, "tol": 1e-4, **p}))),
    ModelSpec("rf", "classification", lambda d, k, p: [
        RandomForest(**{"numClasses": max(k, 2), "numTrees": 200, "maxDepth": FOREST_DEPTH, "seed": SEED, **p})]),
    ModelSpec("knn", "classification", lambda d, k, p: _scaled(
        NearestNeighbors(featuresCol="scaled", **{"numClasses": max(k, 2), **p}))),
    ModelSpec("svm", "classification", lambda d, k, p: _scaled(
        _binary_or_rest(LinearSVC(featuresCol="scaled", **{"maxIter": 100, "tol": 1e-3, **p}), k))),
    ModelSpec("nb", "classification", lambda d, k, p: [NaiveBayes(**{"modelType": "gaussian", **p})]),
    ModelSpec("mlp", "classification", lambda d, k, p: _scaled(MultilayerPerceptronClassifier(
        featuresCol="scaled", **{"layers": [d, 100, max(k, 2)], "maxIter": 1000, "seed": SEED, **p}))),
    ModelSpec("gbt", "classification", lambda d, k, p: [BoostedTrees(**{"numClasses": max(k, 2), "seed": SEED, **p})]),
    ModelSpec("svm_kernel", "classification", lambda d, k, p: _scaled(
        KernelMachine(featuresCol="scaled", **{"numClasses": max(k, 2), "seed": SEED, **p}))),
    ModelSpec("mlp_adam", "classification", lambda d, k, p: _scaled(
        NeuralNetwork(featuresCol="scaled", **{"numClasses": max(k, 2), "seed": SEED, **p}))),
)}
REGRESSORS = {s.name: s for s in (
    ModelSpec("lin_reg", "regression", lambda d, k, p: _scaled(LinearRegression(featuresCol="scaled", **p))),
    ModelSpec("rf_reg", "regression", lambda d, k, p: [
        RandomForest(**{"numTrees": 300, "maxDepth": FOREST_DEPTH, "seed": SEED, **p})]),
    ModelSpec("knn_reg", "regression", lambda d, k, p: _scaled(NearestNeighbors(featuresCol="scaled", **p))),
    ModelSpec("gbt_reg", "regression", lambda d, k, p: [BoostedTrees(**{"seed": SEED, **p})]),
    ModelSpec("svr", "regression", lambda d, k, p: _scaled(KernelMachine(featuresCol="scaled", **{"seed": SEED, **p}))),
    ModelSpec("mlp_reg", "regression", lambda d, k, p: _scaled(NeuralNetwork(featuresCol="scaled", **{"seed": SEED, **p}))),
)}
MODELS = {**CLASSIFIERS, **REGRESSORS}
PENALIZED = ("log_reg", "svm")


@dataclass(frozen=True)
class Candidate:
    """A model and whether a table of this shape suits it; ``reason`` says why not."""

    spec: ModelSpec
    recommended: bool
    reason: str | None


def candidates(task: str, rows: int, features: int, categorical: int) -> list[Candidate]:
    """All models of a task, each with a recommendation by the shape of the table."""
    found = []
    for spec in (CLASSIFIERS if task == "classification" else REGRESSORS).values():
        reason = None
        if spec.name in ("gbt", "gbt_reg") and rows < SMALL_ROWS:
            reason = f"fewer than {SMALL_ROWS} rows"
        elif spec.name == "svm" and features > WIDE_FEATURES:
            reason = f"more than {WIDE_FEATURES} features"
        elif spec.name in ("knn", "knn_reg") and features > VERY_WIDE_FEATURES:
            reason = f"more than {VERY_WIDE_FEATURES} features"
        elif spec.name == "nb" and categorical == 0:
            reason = "no categorical feature"
        found.append(Candidate(spec, reason is None, reason))
    return found


def training_rows(df: DataFrame) -> DataFrame:
    """Features and label, written once: iterative fits then read compact rows with a short lineage
    that survives lost executors. Small tables go into few tasks, as every iteration is a job."""
    rows = checkpointed(df.select("features", "label"))
    return rows.coalesce(max(1, rows.count() // ROWS_PER_TASK))


def fit_prepared(spec: ModelSpec, sets: list[DataFrame], sizes: list[int], classes: int, params: dict) -> list[PipelineModel]:
    """One model per training set of rows (features, label) as ``training_rows`` gives them. Trees grow
    for all sets together; other models fit their sets side by side, as an iteration is a job that leaves most tasks idle."""
    stages = [spec.stages(size, classes, params) for size in sizes]
    if all(isinstance(s[-1], (BoostedTrees, RandomForest)) and len(s) == 1 for s in stages):
        return [PipelineModel([m]) for m in stages[0][0].fit_all(sets)]

    def fit(rows: DataFrame, size: int) -> PipelineModel:
        own = params
        if spec.name in PENALIZED:  # a unit penalty on the sum of losses, as Spark divides that sum by the rows
            own = {"regParam": 1 / max(1, rows.count()), **params}
        return Pipeline(stages=spec.stages(size, classes, own)).fit(rows)

    with ThreadPoolExecutor(max_workers=min(MOST_FITS, max(1, len(sets)))) as pool:
        return list(pool.map(fit, sets, sizes))


def prepare(train: DataFrame, features=None, label: str = "label") -> tuple:
    """(encoder or None, its training rows, number of features) of a training set.

    ``features`` names raw columns to encode; without it the frame brings a ``features`` vector.
    """
    rows = train.withColumn("label", col(label).cast("double")).where(F.col("label").isNotNull())
    if features is None:
        prepared = training_rows(rows)
        return None, prepared, len(prepared.select(vector_to_array("features").alias("f")).first()["f"])
    encoder = feature_encoder(rows, list(features)).fit(rows)
    return encoder, training_rows(encoder.transform(rows)), len(encoder.feature_names())


def fit_model(train: DataFrame, spec: ModelSpec, features=None, label: str = "label", classes: int = 0, **params) -> PipelineModel:
    """Encoder and estimator fitted on the training rows only.

    ``features`` names raw columns to encode; without it the frame brings a ``features`` vector.
    The label column is numeric: the class code, or the value to predict.
    """
    encoder, rows, size = prepare(train, features, label)
    fitted = fit_prepared(spec, [rows], [size], classes, params)[0]
    return PipelineModel([encoder, *fitted.stages]) if encoder is not None else fitted


def with_score(predictions: DataFrame) -> DataFrame:
    """Add ``score``, the evidence for class 1: its probability, else the raw margin."""
    source = next((c for c in ("probability", "rawPrediction") if c in predictions.columns), None)
    score = F.get(vector_to_array(source), F.lit(1)) if source else F.lit(None).cast("double")
    return predictions.withColumn("score", score)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_rows(model: PipelineModel, df: DataFrame, features, target: str, classes=()) -> DataFrame:
    """The rows with ``predicted_<target>``; class codes become labels again."""
    lost = [c for c in features if c not in df.columns]
    if lost:
        raise ValueError(f"columns missing from the rows to score: {', '.join(lost)}")
    scored = model.transform(df)
    value = F.col("prediction")
    if classes:
        value = F.get(F.array(*[F.lit(c) for c in classes]), value.cast("int"))
    return scored.select(*[col(c) for c in df.columns], value.alias(f"predicted_{target}"))
