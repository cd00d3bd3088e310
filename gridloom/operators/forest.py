"""Random forests grown on cells, all trees of all training sets together.

Features are cut into at most 32 bins, as Spark's forests cut them. One job draws the rows of all trees and adds them up
per cell; a task then grows a tree from its cells, level by level. Training sets with too many cells for that are
left to Spark's own forests, which look at all rows once per group of nodes.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from .boosting import WHOLE, binned, binned_blocks, whole_labels
from .cells import MOST_CELLS, cell_bins, cells_of, drawn_sums

FOREST_BINS = 32
LEAST_GAIN = 1e-12  # of the spread among all cells
ROWS_AT_ONCE = 2048  # distinct rows that meet all trees


@dataclass
class Trees:
    """Nodes of all trees, one after the other: ``feature`` -1 is a leaf, bin <= ``cut`` goes to ``left``, else to the next."""

    cuts: list
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def joined(cls, cuts: list, trees: list) -> "Trees":
        roots = np.cumsum([0, *[len(t[0]) for t in trees]])[:-1]
        left = [np.where(t[0] >= 0, t[2] + root, 0).astype(np.int32) for t, root in zip(trees, roots)]
        return cls(cuts, roots.astype(np.int32), *[np.concatenate([t[i] for t in trees]) for i in (0, 1)],
                   np.concatenate(left), np.concatenate([t[3] for t in trees]))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Mean value over the trees for rows of bins."""
        rows = np.arange(len(x))[:, None]
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at].mean(axis=1)
            right = x[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)


def grow_tree(x: np.ndarray, sums: np.ndarray, classes: int, depth: int, tried: int, rng) -> tuple:
    """(feature, cut, left, value per node, gain per feature) of a tree on cells ``x`` with ``sums`` as ``drawn_sums`` gives them.

    ``tried`` features are drawn for every node. A cut gains what it takes from the Gini impurity or the variance,
    times rows; ties go to the lower feature and cut.
    """
    live = np.flatnonzero((sums.sum(0) if classes else sums[0]) > 0)
    x = x[live]
    sums = sums[:, live].astype(float)
    w, v = (sums.sum(0), sums) if classes else (sums[0], sums[1:])
    bins = x.max(0).astype(int) + 1 if len(x) else np.zeros(x.shape[1], int)
    gains = np.zeros(x.shape[1])
    least = LEAST_GAIN * (v * v / np.maximum(w, 1)).sum() if len(x) else 0.0
    feature, cut, left = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
    value = [(v.sum(1) / max(w.sum(), 1.0))[None, :]]
    at, n, made = np.zeros(len(x), np.int64), 1, 1
    opened = np.zeros(1, np.int64)  # nodes to look at, all among those made last
    for _ in range(depth):
        if not len(x) or not x.shape[1]:
            break
        chosen = np.argsort(rng.random((n, x.shape[1])), axis=1)[:, :tried]
        allowed = np.zeros((n, x.shape[1]), bool)
        allowed[np.arange(n)[:, None], chosen] = True
        all_w = np.bincount(at, w, n)
        all_v = np.stack([np.bincount(at, c, n) for c in v])
        before = (all_v * all_v).sum(0) / all_w
        best, best_f, best_cut = np.full(n, least), np.full(n, -1, np.int16), np.zeros(n, np.uint8)
        for f in np.flatnonzero(bins > 1).tolist():
            nodes = np.flatnonzero(allowed[:, f])
            if not len(nodes):
                continue
            slot = np.full(n, -1)
            slot[nodes] = np.arange(len(nodes))
            rows = np.flatnonzero(allowed[at, f])
            place, shape = slot[at[rows]] * bins[f] + x[rows, f], (len(nodes), bins[f])
            left_w = np.cumsum(np.bincount(place, w[rows], shape[0] * shape[1]).reshape(shape), axis=1)[:, :-1]
            right_w = all_w[nodes, None] - left_w
            gain = -before[nodes, None]
            for c in range(len(v)):
                left_v = np.cumsum(np.bincount(place, v[c, rows], shape[0] * shape[1]).reshape(shape), axis=1)[:, :-1]
                right_v = all_v[c, nodes, None] - left_v
                gain = gain + left_v * left_v / np.maximum(left_w, 1) + right_v * right_v / np.maximum(right_w, 1)
            gain = np.where((left_w > 0) & (right_w > 0), gain, 0.0)
            found = gain.argmax(1)
            top = gain[np.arange(len(nodes)), found]
            take = top > best[nodes]
            best[nodes[take]], best_f[nodes[take]], best_cut[nodes[take]] = top[take], f, found[take]
        split = best_f >= 0
        if not split.any():
            break
        np.add.at(gains, best_f[split], best[split])
        child = np.zeros(n, np.int64)
        child[split] = 2 * np.arange(split.sum())
        feature[-1][opened], cut[-1][opened], left[-1][opened] = best_f, best_cut, np.where(split, made + child, 0)
        kept = np.flatnonzero(split[at])
        x, w, v, old = x[kept], w[kept], v[:, kept], at[kept]
        at = child[old] + (x[np.arange(len(x)), best_f[old]] > best_cut[old])
        count = 2 * int(split.sum())
        child_w = np.bincount(at, w, count)
        value.append((np.stack([np.bincount(at, c, count) for c in v]) / child_w).T)
        feature.append(np.full(count, -1, np.int16))
        cut.append(np.zeros(count, np.uint8))
        left.append(np.zeros(count, np.int32))
        several = np.bincount(at, minlength=count) > 1  # a cell alone cannot be cut
        new = np.cumsum(several) - 1
        kept = np.flatnonzero(several[at])
        x, w, v, at = x[kept], w[kept], v[:, kept], new[at[kept]]
        opened, made, n = np.flatnonzero(several), made + count, int(several.sum())
        if not n:
            break
    total = gains.sum()
    return tuple(np.concatenate(p) for p in (feature, cut, left, value)) + (gains / total if total > 0 else gains,)


def _grown(cells, sizes: dict, classes: int, depth: int, seed: int, tried):
    def run(items):
        for (number, tree), sums in items:
            x = cell_bins(cells.value[number], sizes[number])
            found = grow_tree(x, sums, classes, depth, tried(sizes[number]), np.random.default_rng([seed, number, tree, 1]))
            yield number, tree, zlib.compress(pickle.dumps(found, protocol=5), 1)

    return run


class _ForestParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes, or 0 for a number", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 256", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def _start(self, given: dict):
        self._setDefault(featuresCol="features", labelCol="label", numClasses=0, numTrees=20, maxDepth=5,
                         maxBins=FOREST_BINS, seed=42)
        self._set(**{k: v for k, v in given.items() if v is not None})


class RandomForest(Estimator, _ForestParams):
    """Trees on rows drawn with replacement; a node looks at the root of the features for classes, a third for a number."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, numClasses=None, numTrees=None, maxDepth=None, maxBins=None, seed=None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame):
        return self.fit_all([df])[0]

    def fit_all(self, sets: list[DataFrame]) -> list:
        """One model per training set, all grown together."""
        get = {p.name: self.getOrDefault(p) for p in self.params}
        classes, trees, depth, seed = get["numClasses"], get["numTrees"], get["maxDepth"], get["seed"]
        rows = [df.select(col(get["featuresCol"]).alias("features"), col(get["labelCol"]).cast("double").alias("label")) for df in sets]
        packed = binned_blocks(rows, classes, min(256, get["maxBins"]))
        sizes = {n: len(about[2]) for n, about in packed.about.items()}
        cells = cells_of(packed.blocks, sizes, dict.fromkeys(sizes, MOST_CELLS))
        shared = rows[0].sparkSession.sparkContext.broadcast(cells)  # at most MOST_CELLS rows of bins a set
        grown: dict = {n: {} for n in cells}
        if cells:
            def tried(size: int) -> int:
                share = np.sqrt(size) if classes else size / 3
                return size if trees == 1 else max(1, int(np.ceil(share)))

            def weigh(number, draw, key, n):
                return np.random.default_rng([seed, number, draw, key]).poisson(1.0, n)

            whole = {n: whole_labels(*packed.about[n][:2]) for n in cells} if not classes else {}
            total = sum(packed.rows[n] for n in cells)
            sums = drawn_sums(packed.chosen(list(cells)), total, shared, whole, classes, trees, weigh)
            for number, tree, body in sums.mapPartitions(_grown(shared, sizes, classes, depth, seed, tried)).collect():
                grown[number][tree] = pickle.loads(zlib.decompress(body))
        shared.unpersist()
        models = []
        for number, df in enumerate(sets):
            if number not in cells:
                models.append(self._by_nodes(df, get))
                continue
            start, scale, cuts = packed.about[number]
            found = [grown[number][tree] for tree in range(trees)]
            joined = Trees.joined(cuts, found)
            if not classes:
                joined.value = start[0] + joined.value * (scale / WHOLE)
            gains = np.sum([f[4] for f in found], axis=0)
            models.append(self._copyValues(RandomForestModel(joined, gains / gains.sum() if gains.sum() else gains)))
        return models

    def _by_nodes(self, df: DataFrame, get: dict):
        """Spark's forest, for a training set without rows or with too many cells."""
        forest = RandomForestClassifier if get["numClasses"] else RandomForestRegressor
        return forest(**{k: v for k, v in get.items() if k != "numClasses"}).fit(df)


class RandomForestModel(Model, _ForestParams, MLWritable, MLReadable):
    def __init__(self, trees: Trees | None = None, gains: np.ndarray | None = None):
        super().__init__()
        self._start({})
        self.trees, self.gains = trees, gains

    @property
    def featureImportances(self):
        """Gain per feature, scaled to 1 for a tree and again for all trees."""
        return Vectors.dense(self.gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and for classes ``probability``. Rows with equal bins share one look."""
        trees = self.trees

        @F.pandas_udf("array<double>")
        def means(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x, back = np.unique(binned(np.stack(features.to_numpy()), trees.cuts), axis=0, return_inverse=True)
            found = np.concatenate([trees.values(x[i:i + ROWS_AT_ONCE]) for i in range(0, len(x), ROWS_AT_ONCE)])
            return pd.Series(list(found[back.ravel()]))

        found = df.withColumn("__value", means(vector_to_array(col(self.getOrDefault(self.featuresCol)))))
        if not self.getOrDefault(self.numClasses):
            return found.withColumn("prediction", F.col("__value")[0]).drop("__value")
        best = F.array_position("__value", F.array_max("__value")) - 1
        return found.withColumns({"probability": array_to_vector("__value"), "prediction": best.cast("double")}).drop("__value")

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, model = SparkSession.active(), self.model
        DefaultParamsWriter.saveMetadata(model, path, spark)
        t = model.trees
        nodes = pd.DataFrame({"node": np.arange(len(t.feature)), "feature": t.feature.astype(np.int32), "cut": t.cut.astype(np.int32),
                              "left": t.left, "value": t.value.tolist()})
        spark.createDataFrame(nodes, "node long, feature int, cut int, left int, value array<double>").write.parquet(f"{path}/nodes")
        about = [([c.tolist() for c in t.cuts], t.roots.tolist(), [float(g) for g in model.gains])]
        spark.createDataFrame(about, "cuts array<array<double>>, roots array<int>, gains array<double>").write.parquet(f"{path}/about")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
        about = spark.read.parquet(f"{path}/about").first()
        trees = Trees([np.array(c, float) for c in about["cuts"]], np.array(about["roots"], np.int32),
                      nodes["feature"].to_numpy(np.int16), nodes["cut"].to_numpy(np.uint8), nodes["left"].to_numpy(np.int32),
                      np.stack(nodes["value"].to_numpy()).astype(float))
        model = RandomForestModel(trees, np.array(about["gains"], float))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
