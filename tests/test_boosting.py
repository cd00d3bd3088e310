"""Boosted trees against a plain booster, and the two ways to grow against each other."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridloom.operators import boosting as B
from gridloom.session import scratch_path


def table(spark, x, y):
    rows = [(r, float(v)) for r, v in zip(x.tolist(), y)]
    df = spark.createDataFrame(rows, "f array<double>, label double")
    return df.select(array_to_vector("f").alias("features"), "label")


def data(kind, rows=500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(-15, 16, size=(rows, 4)) / 10
    if kind == "number":
        y = 3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(size=rows)
    elif kind == "two":
        y = (x[:, 0] * x[:, 1] > 0).astype(float)
    else:
        y = np.digitize(x[:, 0] + x[:, 2], [-0.65, 0.65]).astype(float)
    return x, y


def plain_trees(x, y, start, classes, scale, rounds, depth, rate_):
    """Per round and class {node: (feature, threshold)} by looking at every cut of every feature."""
    out, margins = [], np.tile(start, (len(x), 1))
    for round_ in range(rounds):
        rate = rate_ if round_ else 1.0
        first, second = B.derivatives(margins, y, classes, scale)
        trees, added = [], np.zeros_like(margins)
        for c in range(margins.shape[1]):
            g, h = first[:, c], second[:, c]
            tree, nodes = {}, {0: np.arange(len(x))}
            added[:, c] = -rate * scale * g.sum() / (h.sum() + B.WHOLE)
            while nodes:
                node, rows = nodes.popitem()
                best = (1e-12, None)
                total_g, total_h = g[rows].sum() / B.WHOLE, h[rows].sum() / B.WHOLE
                for f in range(x.shape[1]):
                    for t in np.unique(x[:, f])[:-1]:
                        left = rows[x[rows, f] <= t]
                        lg, lh = g[left].sum() / B.WHOLE, h[left].sum() / B.WHOLE
                        if lh < 1 or total_h - lh < 1:
                            continue
                        gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                        if gain > best[0]:
                            best = (gain, (f, t))
                if best[1] is None:
                    continue
                f, t = tree[node] = best[1]
                for side, child in ((x[rows, f] <= t, 2 * node + 1), (x[rows, f] > t, 2 * node + 2)):
                    some = rows[side]
                    added[some, c] = -rate * scale * g[some].sum() / (h[some].sum() + B.WHOLE)
                    if child < (1 << depth) - 1:
                        nodes[child] = some
            trees.append(tree)
        margins += added
        out.append(trees)
    return out, margins


def cuts_of(trees):
    return [[{int(n): (int(t.feature[n]), t.threshold[n]) for n in np.flatnonzero(t.feature >= 0)} for t in r] for r in trees]


@pytest.mark.parametrize("kind, classes", [("number", 0), ("two", 2), ("three", 3)])
def test_same_splits_as_a_plain_booster(spark, monkeypatch, kind, classes):
    x, y = data(kind)
    df = table(spark, x, y)
    start, scale, count = B._starts(df, classes)
    assert count == len(x)
    want, margins = plain_trees(x, y, start, classes, scale, rounds=3, depth=3, rate_=0.3)
    found = {}
    for rows in (B.BLOCK_ROWS, 90):  # one block grown in a task; several grown by jobs
        monkeypatch.setattr(B, "BLOCK_ROWS", rows)
        monkeypatch.setattr(B, "ROUNDS_KEPT", 2)
        found[rows] = B.grow([df], classes, 3, 3, 0.3, 1.0, 1.0, 7)[0][1]
        assert cuts_of(found[rows]) == want
    values = [[np.concatenate([t.value for t in r]) for r in trees] for trees in found.values()]
    assert all(np.array_equal(a, b) for a, b in zip(*values))
    model = B.BoostedTreesModel(start, found[90])
    model._set(numClasses=classes)
    got = model.transform(df).withColumn("f", F.col("features")).toPandas()
    if classes == 0:
        assert np.allclose(np.sort(got["prediction"]), np.sort(margins[:, 0]))


def test_rows_and_columns_drawn_alike_in_task_and_jobs(spark):
    x, y = data("two")
    cuts = [np.unique(x[:, i])[:-1] for i in range(4)]
    block = (3, B.binned(x, cuts), y, 12345, np.zeros((len(x), 1)))
    plan = B._Plan(2, 4, 4, 0.1, 0.8, 0.5, 5, {3: (np.zeros(1), 1.0, cuts)})
    here = B._grow_in_task(plan, block)[3]
    jobs = B._grow_by_jobs(plan, spark.sparkContext.parallelize([block], 2))[3]
    assert cuts_of(here) == cuts_of(jobs)
    used = {f for r in here for t in r for f in t.feature[t.feature >= 0].tolist()}
    assert all(len(set(t.feature[t.feature >= 0].tolist())) <= 2 for r in here for t in r) and len(used) > 2


@pytest.mark.parametrize("kind, classes", [("number", 0), ("two", 2), ("three", 3)])
def test_learns_saves_and_grows_sets_together(spark, kind, classes):
    x, y = data(kind, 800)
    df, other = table(spark, x, y), table(spark, *data(kind, 300, 1))
    estimator = B.BoostedTrees(numClasses=classes, maxIter=40)
    alone, (model, second) = estimator.fit(df), estimator.fit_all([df, other])
    assert cuts_of(alone.trees) == cuts_of(model.trees) and cuts_of(second.trees) != cuts_of(model.trees)
    scored = model.transform(df)
    if classes:
        assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.97
    else:
        assert scored.agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0] < 0.2 * y.var()
    path = scratch_path(spark, "boosted")
    model.write().overwrite().save(path)
    pick = lambda m: sorted(r["prediction"] for r in m.transform(df).select("prediction").collect())
    assert pick(B.BoostedTreesModel.load(path)) == pick(model)


def test_odd_training_sets(spark):
    nan = float("nan")
    x = np.array([[nan, 1.0], [nan, 1.0], [1.0, 1.0], [2.0, 1.0]] * 10)
    model = B.BoostedTrees(maxIter=30, subsamplingRate=1.0, columnRate=1.0).fit(table(spark, x, [5, 5, 0, 0] * 10))
    got = {r["prediction"] > 2.5 for r in model.transform(table(spark, x, [1] * 40)).where("label = 1").limit(2).collect()}
    assert got == {True}  # missing numbers go right
    constant = B.BoostedTrees(maxIter=3).fit(table(spark, x, [4.0] * 40))
    assert {r["prediction"] for r in constant.transform(table(spark, x, [0] * 40)).collect()} == {4.0}
    empty = B.BoostedTrees(maxIter=3).fit(table(spark, x, [4.0] * 40).limit(0))
    assert empty.transform(table(spark, x, [0] * 40)).first()["prediction"] == 0
    with pytest.raises(ValueError, match="7"):
        B.BoostedTrees(numClasses=3).fit(table(spark, x, [7] * 40))


@pytest.mark.parametrize("kind, classes", [("number", 0), ("two", 2), ("three", 3)])
def test_few_cells_grow_as_all_rows_without_a_job_per_level(spark, monkeypatch, kind, classes):
    x, y = data(kind, 1200)
    x = np.round(x)  # 4 ** 4 cells at most
    df = table(spark, x, y)
    ways = {}
    for gain in (1, 10**6):  # on cells; by jobs
        monkeypatch.setattr(B, "BLOCK_ROWS", 90)
        monkeypatch.setattr(B, "CELL_GAIN", gain)
        if gain == 1:
            monkeypatch.setattr(B, "_grow_by_jobs", None)
        ways[gain] = B.grow([df], classes, 4, 3, 0.3, 0.8, 0.5, 7)[0][1]
        monkeypatch.undo()
    assert cuts_of(ways[1]) == cuts_of(ways[10**6])
    values = [np.concatenate([t.value for r in trees for t in r]) for trees in ways.values()]
    assert np.allclose(*values, rtol=0, atol=1e-6)
