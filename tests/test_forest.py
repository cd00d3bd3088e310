"""Forests grown on cells: against a plain tree, their draws, their jobs, and what is left to Spark's own forests."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridloom.operators import boosting as B
from gridloom.operators import forest as R
from gridloom.operators.rank import tree_scores
from gridloom.session import scratch_path


def table(spark, x, y):
    df = spark.createDataFrame([(r, float(v)) for r, v in zip(x.tolist(), y)], "f array<double>, label double")
    return df.select(array_to_vector("f").alias("features"), "label")


def data(classes, rows=900, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, size=(rows, 3)).astype(float)
    y = x[:, 0] * 2 + x[:, 1] ** 2
    return x, (np.digitize(y, [8, 20]).astype(float) if classes else y)


def jobs(spark, run):
    spark.sparkContext.setJobGroup("forest", "forest")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def plain_tree(x, w, v, depth):
    """{path: (feature, cut)} by looking at every cut."""
    out, nodes = {}, [("", np.arange(len(x)))]
    while nodes:
        path, rows = nodes.pop()
        best = (1e-9, None)
        half = lambda r: (v[:, r].sum(1) ** 2).sum() / w[r].sum()
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1].tolist():
                left = x[rows, f] <= cut
                gain = half(rows[left]) + half(rows[~left]) - half(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
        if best[1] is None or len(path) == depth:
            continue
        f, cut = out[path] = best[1]
        left = x[rows, f] <= cut
        nodes += [(path + "l", rows[left]), (path + "r", rows[~left])]
    return out


@pytest.mark.parametrize("classes", [0, 3])
def test_same_splits_as_a_plain_tree(classes):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 5, size=(80, 3)), axis=0).astype(np.uint8)
    drawn = rng.poisson(1.5, len(x))
    if classes:
        label = rng.integers(0, 3, len(x))
        sums = np.stack([drawn * (label == c) for c in range(3)])
        w, v = sums.sum(0).astype(float), sums.astype(float)
    else:
        sums = np.stack([drawn, drawn * rng.integers(-50, 50, len(x))])
        w, v = sums[0].astype(float), sums[1:].astype(float)
    feature, cut, left, value, gains = R.grow_tree(x, sums, classes, 4, 3, rng)
    kept = w > 0
    found, nodes = {}, [("", 0)]
    while nodes:
        path, node = nodes.pop()
        if feature[node] >= 0:
            found[path] = (int(feature[node]), int(cut[node]))
            nodes += [(path + "l", left[node]), (path + "r", left[node] + 1)]
    assert found == plain_tree(x[kept], w[kept], v[:, kept], 4)
    assert np.allclose(value[0], v.sum(1) / w.sum()) and np.isclose(gains.sum(), 1)


@pytest.mark.parametrize("classes", [0, 3])
def test_learns_saves_and_takes_blocks_of_any_size(spark, monkeypatch, classes):
    x, y = data(classes)
    df, other = table(spark, x, y), table(spark, *data(classes, 300, 1))
    for rows in (B.BLOCK_ROWS, 100):
        monkeypatch.setattr(B, "BLOCK_ROWS", rows)
        model, second = R.RandomForest(numClasses=classes, numTrees=30, maxDepth=30).fit_all([df, other])
        assert isinstance(second, R.RandomForestModel) and len(model.trees.roots) == 30
        scored = model.transform(df)
        if classes:
            assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.97
        else:
            assert scored.agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0] < 0.1 * y.var()
        assert model.featureImportances[2] < model.featureImportances[0]
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    pick = lambda m: sorted(r["prediction"] for r in m.transform(df).select("prediction").collect())
    assert pick(R.RandomForestModel.load(path)) == pick(model)


def test_jobs_do_not_grow_with_depth(spark):
    x, y = data(0)
    df = table(spark, x, y)
    from gridloom.operators.models import REGRESSORS, fit_model
    counts = [jobs(spark, lambda: fit_model(df, REGRESSORS["rf_reg"], numTrees=10, maxDepth=d)) for d in (2, 20)]
    assert counts[0] == counts[1]


def test_jobs_of_importances_do_not_grow_with_depth(spark):
    x, y = data(0)
    df = spark.createDataFrame([(*r, float(v)) for r, v in zip(x.tolist(), y)], "a double, b double, c double, y double")
    counts = [jobs(spark, lambda: tree_scores(df, ["a", "b", "c"], "y", "regression", 10, d)) for d in (2, 20)]
    assert counts[0] == counts[1]


def test_many_cells_and_odd_sets(spark, monkeypatch):
    x, y = data(0, 200)
    monkeypatch.setattr(R, "MOST_CELLS", 20)
    model = R.RandomForest(numTrees=3).fit(table(spark, x, y))
    assert not isinstance(model, R.RandomForestModel) and model.getNumTrees == 3
    monkeypatch.undo()
    nan = float("nan")
    x = np.array([[nan, 1.0], [1.0, 1.0]] * 20)
    model = R.RandomForest(numTrees=5).fit(table(spark, x, [5, 0] * 20))
    got = [r["prediction"] for r in model.transform(table(spark, x, [5, 0] * 20)).orderBy("label").collect()]
    assert got[0] < 2.5 < got[-1]
    constant = R.RandomForest(numTrees=5).fit(table(spark, x, [4.0] * 40))
    assert {r["prediction"] for r in constant.transform(table(spark, x, [0] * 40)).collect()} == {4.0}
