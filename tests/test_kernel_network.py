"""Kernel support vectors and the neural network against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridloom.operators import blocks as rows_of
from gridloom.operators.kernel import KernelMachine, losses, mapped
from gridloom.operators.models import CLASSIFIERS, REGRESSORS, fit_model, load_model, save_model, with_score
from gridloom.operators.network import NeuralNetwork, Training, first_weights, loss_and_gradient, train
from gridloom.session import scratch_path


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, label double").withColumn("features", array_to_vector("v"))


@pytest.fixture(scope="module")
def rings():
    rng = np.random.default_rng(1)
    angle, label = rng.uniform(0, 2 * math.pi, 600), np.arange(600) % 2
    radius = 1 + label * 1.5 + rng.normal(0, 0.15, 600)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]), label


def share_right(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_kernel_separates_rings(spark, rings):
    df = frame(spark, *rings)
    kernel = fit_model(df, CLASSIFIERS["svm_kernel"], None, "label", classes=2)
    linear = fit_model(df, CLASSIFIERS["svm"], None, "label", classes=2)
    assert share_right(kernel, df) > 0.95 and share_right(linear, df) < 0.65
    scored = with_score(kernel.transform(df))
    assert scored.where("(score > 0) <> (prediction = 1)").count() == 0


def test_features_stand_for_the_kernel():
    rng = np.random.default_rng(0)
    x, directions = rng.normal(size=(40, 3)), rng.normal(size=(3, 20000)) * math.sqrt(2 * 0.3)
    z = mapped(x, directions)[:, :-1]
    wanted = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - wanted).max() < 0.05


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_kernel_weights_are_optimal(spark, rings, classes, monkeypatch):
    """The gradient of the objective, by a plain loop over rows, is zero at the weights found; also over several blocks."""
    monkeypatch.setattr(rows_of, "BLOCK_ROWS", 150)
    x, label = rings
    y = label if classes == 2 else (np.arange(len(x)) % 3 if classes == 3 else x[:, 0] * 2 + 5)
    model = KernelMachine(numClasses=classes, directions=20, gamma=0.5, tol=1e-12).fit(frame(spark, x, y))
    directions, weights, (mean, scale) = (model.arrays[n] for n in ("directions", "weights", "label"))
    for at, k in enumerate([0] if classes == 0 else [1] if classes == 2 else [0, 1, 2]):
        w, gradient = weights[:, at], weights[:, at].copy()
        gradient[-1] = 0
        for row, value in zip(x, y):
            angles = row @ directions
            z = np.array([*np.cos(angles) / math.sqrt(20), *np.sin(angles) / math.sqrt(20), 1.0])
            if classes:
                t = 1 if value == k else -1
                gradient -= 2 * max(0, 1 - t * (w @ z)) * t * z
            else:
                error = w @ z - (value - mean) / scale
                gradient += 2 * max(0, abs(error) - 0.1) * math.copysign(1, error) * z
        assert np.abs(gradient).max() < 1e-3 * len(x)
    if not classes:
        assert (mean, scale) == pytest.approx((y.mean(), y.std()))


def test_loss_derivatives():
    rng = np.random.default_rng(2)
    z, t, w = rng.normal(size=(50, 4)), rng.choice([-1.0, 1.0], 50), rng.normal(size=4)
    for epsilon in (None, 0.1):
        _, gradient, curvature = losses(z, t, w, epsilon)
        for i in range(4):
            step = np.zeros(4)
            step[i] = 1e-6
            up, down = losses(z, t, w + step, epsilon), losses(z, t, w - step, epsilon)
            assert (up[0] - down[0]) / 2e-6 == pytest.approx(gradient[i], rel=1e-4, abs=1e-4)
            assert (up[1] - down[1]) / 2e-6 == pytest.approx(curvature[i], rel=1e-3, abs=1e-2)


def test_regressions_follow_a_curve(spark):
    x = np.linspace(-3, 3, 400)[:, None]
    df = frame(spark, x, 1000 + 50 * np.sin(x[:, 0]))
    for name, params in (("svr", {}), ("mlp_reg", {"stepSize": 0.01, "maxIter": 200})):
        model = fit_model(df, REGRESSORS[name], None, "label", **params)
        assert model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 15, name


@pytest.mark.parametrize("classes", [0, 3])
def test_network_gradient_is_numeric_gradient(classes):
    rng = np.random.default_rng(3)
    layers = [4, 5, 3, classes or 1]
    flat, x = first_weights(layers, 1), rng.normal(size=(20, 4))
    y = rng.integers(0, 3, 20) if classes else rng.normal(size=20)
    _, gradient = loss_and_gradient(flat, layers, x, y, classes, 0.01)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, _ = loss_and_gradient(flat + step, layers, x, y, classes, 0)
        down, _ = loss_and_gradient(flat - step, layers, x, y, classes, 0)
        plain, _ = (up - down) / 2e-6, None
        _, bare = loss_and_gradient(flat, layers, x, y, classes, 0)
        assert bare[i] == pytest.approx(plain, rel=1e-3, abs=1e-6)
    assert not np.allclose(gradient, bare)


def plain_rounds(parts, training, rounds):
    """Rounds of averaged Adam passes, written out for a network with one hidden layer."""
    a, b, c = training.layers
    flat = first_weights(training.layers, training.seed)
    state = [flat, np.zeros_like(flat), np.zeros_like(flat), 0.0]
    seen = []
    for round_ in range(rounds):
        seen.append(state[0])
        after, total = None, 0
        for x, y, number in parts:
            kept = np.random.default_rng([training.seed, number]).random(len(y)) >= training.held_out
            x, y = x[kept], y[kept].astype(int)
            w, m, v, steps = state[0].copy(), state[1].copy(), state[2].copy(), state[3]
            order = np.random.default_rng([training.seed, number, round_]).permutation(len(x))
            for at in range(0, len(x), training.batch_rows):
                xs, ys = x[order[at:at + training.batch_rows]], y[order[at:at + training.batch_rows]]
                w1, b1 = w[:a * b].reshape(a, b), w[a * b:a * b + b]
                w2, b2 = w[a * b + b:a * b + b + b * c].reshape(b, c), w[a * b + b + b * c:]
                h = np.maximum(xs @ w1 + b1, 0)
                e = np.exp(h @ w2 + b2)
                d2 = e / e.sum(1, keepdims=True) - np.eye(c)[ys]
                d1 = d2 @ w2.T * (h > 0)
                g = np.concatenate([((xs.T @ d1 + training.penalty * w1) / len(xs)).ravel(), d1.mean(0),
                                    ((h.T @ d2 + training.penalty * w2) / len(xs)).ravel(), d2.mean(0)])
                steps += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                w -= training.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8 / np.sqrt(1 - 0.999**steps))
            found = [len(x) * np.asarray(s) for s in (w, m, v, steps)]
            after, total = (found if after is None else [p + q for p, q in zip(after, found)]), total + len(x)
        state = [s / total for s in after]
    return seen


@pytest.mark.parametrize("block_rows", [10_000, 150])
def test_network_rounds_equal_plain_ones(spark, rings, monkeypatch, block_rows):
    """One block in a task, or several averaged by a job per round: the same weights as the plain version."""
    monkeypatch.setattr(rows_of, "BLOCK_ROWS", block_rows)
    blocks, size = rows_of.row_blocks(frame(spark, *rings), "features", "label")
    parts = [rows_of.unpacked(r["body"], size) for r in blocks.collect()]
    assert (len(parts) == 1) == (block_rows == 10_000) and sum(len(p[1]) for p in parts) == 600
    training = Training([2, 8, 2], 2, 0.0, 1.0, 4, 50, 0.01, 1e-4, 0.1, 100, 1e-4, 7)
    found, scores = train(blocks, size, len(parts) == 1, training)
    seen = plain_rounds(parts, training, 5)
    assert len(scores) == 5
    assert np.allclose(found, seen[int(np.argmax(scores))], rtol=1e-9, atol=1e-12)


def test_training_stops_after_ten_rounds_without_gain(spark, rings):
    df = frame(spark, rings[0], np.zeros(600))  # nothing to gain once all rows are right
    model = NeuralNetwork(numClasses=2, stepSize=0.01).fit(df)
    scores = model.arrays["scores"]
    gains = np.flatnonzero(np.diff(np.maximum.accumulate(scores)) > 1e-4)
    assert len(scores) - 1 - (gains[-1] + 1 if len(gains) else 0) == 10
    assert share_right(model, df) == 1


def test_network_learns_rings_and_is_saved(spark, rings):
    df = frame(spark, *rings)
    model = fit_model(df, CLASSIFIERS["mlp_adam"], None, "label", classes=2, stepSize=0.01)
    assert share_right(model, df) > 0.95
    for name in ("mlp_adam", "svm_kernel"):
        model = fit_model(df, CLASSIFIERS[name], None, "label", classes=2)
        path = scratch_path(spark, "model")
        save_model(model, path)
        pick = lambda m: sorted((r["id"], r["prediction"]) for r in m.transform(df).select("id", "prediction").collect())
        assert pick(load_model(path)) == pick(model)


def test_fits_of_odd_tables(spark):
    """No row, one row, equal rows, constant columns, missing labels: a model comes back and predicts."""
    one = frame(spark, [[1.0, 2.0]], [1.0])
    odd = [one, one.union(one), one.union(one.withColumn("label", F.lit(None).cast("double"))), one.limit(0)]
    for df in odd:
        for estimator in (KernelMachine(numClasses=2), KernelMachine(), NeuralNetwork(numClasses=2, maxIter=3), NeuralNetwork(maxIter=3)):
            model = estimator.fit(df)
            if not df.isEmpty():
                found = [r["prediction"] for r in model.transform(df).collect()]
                assert len(found) == df.count() and all(p is not None and math.isfinite(p) for p in found)
    with pytest.raises(Exception, match="no code"):
        NeuralNetwork(numClasses=2).fit(frame(spark, [[0.0], [1.0]], [0.0, 5.0]))
