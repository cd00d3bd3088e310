"""A neural network trained by mini-batch Adam, with early stopping on held-out rows.

Rows stand in blocks. In a round every block starts from the same weights and goes once through its rows in
mini-batches; weights and moments are then averaged by rows, so a round is one job and what moves is the size
of the network. A tenth of the rows is held out: the round first scores the incoming weights on them, and ten
rounds without gain end the fit, which returns the best weights. A table that is a single block (65,536 rows,
32 MB) is trained by the task that holds it, by the same rounds.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ArraysModel, block_sums, class_codes_checked, row_blocks, row_outputs, unpacked

FIRST_DECAY, SECOND_DECAY, TINY = 0.9, 0.999, 1e-8


class _NetworkParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes, or 0 to predict a number", TypeConverters.toInt)
    hidden = Param(Params._dummy(), "hidden", "units of the hidden layers", TypeConverters.toListInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds at most", TypeConverters.toInt)
    batchRows = Param(Params._dummy(), "batchRows", "rows of a mini-batch", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "on squared weights, per row", TypeConverters.toFloat)
    heldOut = Param(Params._dummy(), "heldOut", "share of rows that only score", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "rounds without gain before the end", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "gain of the score that counts", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of first weights, held-out rows and batches", TypeConverters.toInt)

    def _start(self, given: dict):
        self._setDefault(featuresCol="features", labelCol="label", numClasses=0, hidden=[100], maxIter=1000, batchRows=200,
                         stepSize=0.001, penalty=1e-4, heldOut=0.1, patience=10, tol=1e-4, seed=42)
        self._set(**{k: v for k, v in given.items() if v is not None})


def shaped(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of every layer, as views of the flat vector."""
    found, at = [], 0
    for a, b in zip(layers, layers[1:]):
        found.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return found


def first_weights(layers: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    bounds = [np.full(a * b + b, np.sqrt(6 / (a + b))) for a, b in zip(layers, layers[1:])]
    limit = np.concatenate(bounds)
    return rng.uniform(-1, 1, len(limit)) * limit


def outputs(flat: np.ndarray, layers: list[int], x: np.ndarray, classes: int) -> list[np.ndarray]:
    """What every layer gives; the last one shares of classes, or the number."""
    given = [x]
    for weights, bias in shaped(flat, layers):
        given.append(given[-1] @ weights + bias)
        if len(given) < len(layers):
            np.maximum(given[-1], 0, out=given[-1])
    if classes:
        e = np.exp(given[-1] - given[-1].max(1, keepdims=True))
        given[-1] = e / e.sum(1, keepdims=True)
    return given


def loss_and_gradient(flat, layers, x, y, classes: int, penalty: float) -> tuple[float, np.ndarray]:
    """Mean loss (cross-entropy, or half the squared error) with its penalty, and the gradient."""
    given = outputs(flat, layers, x, classes)
    n, out = len(x), given[-1]
    if classes:
        rows = np.arange(n)
        loss = -np.log(np.maximum(out[rows, y], 1e-300)).mean()
        error = out.copy()
        error[rows, y] -= 1
    else:
        error = out - y[:, None]
        loss = 0.5 * (error**2).sum() / n
    gradient = np.empty_like(flat)
    parts, slots = shaped(flat, layers), shaped(gradient, layers)
    for i in reversed(range(len(parts))):
        weights = parts[i][0]
        loss += 0.5 * penalty / n * (weights**2).sum()
        slots[i][0][:] = (given[i].T @ error + penalty * weights) / n
        slots[i][1][:] = error.sum(0) / n
        if i:
            error = (error @ weights.T) * (given[i] > 0)
    return loss, gradient


@dataclass(frozen=True)
class Training:
    layers: list
    classes: int
    mean: float
    scale: float
    rounds: int
    batch_rows: int
    rate: float
    penalty: float
    held_out: float
    patience: int
    tol: float
    seed: int

    def targets(self, y: np.ndarray) -> np.ndarray:
        return class_codes_checked(y, self.classes) if self.classes else (y - self.mean) / self.scale

    def held(self, rows: int, block: int) -> np.ndarray:
        return np.random.default_rng([self.seed, block]).random(rows) < self.held_out

    def adam_pass(self, state: tuple, x, y, round_: int, block: int) -> tuple:
        """One way through the rows in mini-batches. A state is (weights, first moments, second moments, steps)."""
        flat, first, second, steps = state[0].copy(), state[1].copy(), state[2].copy(), float(state[3])
        order = np.random.default_rng([self.seed, block, round_]).permutation(len(x))
        for at in range(0, len(x), self.batch_rows):
            rows = order[at:at + self.batch_rows]
            _, g = loss_and_gradient(flat, self.layers, x[rows], y[rows], self.classes, self.penalty)
            steps += 1
            first = FIRST_DECAY * first + (1 - FIRST_DECAY) * g
            second = SECOND_DECAY * second + (1 - SECOND_DECAY) * g * g
            rate = self.rate * np.sqrt(1 - SECOND_DECAY**steps) / (1 - FIRST_DECAY**steps)
            flat -= rate * first / (np.sqrt(second) + TINY)
        return flat, first, second, steps

    def block_round(self, state: tuple, round_: int, x, y, block: int) -> tuple:
        """Sums of a block: rows, states by rows, and (rows, right or squared errors, labels, their squares) held out and not."""
        y, held = self.targets(y), self.held(len(y), block)
        out = outputs(state[0], self.layers, x, self.classes)[-1]
        wrong = (out.argmax(1) == y).astype(float) if self.classes else (out[:, 0] - y) ** 2
        scores = np.array([[m.sum(), wrong[m].sum(), y[m].sum(), (y[m] ** 2).sum()] for m in (held, ~held)], float)
        rows = float((~held).sum())
        after = self.adam_pass(state, x[~held], y[~held], round_, block)
        return (np.array(rows), *[rows * np.asarray(v) for v in after], scores)

    def score(self, sums: np.ndarray) -> float:
        """Accuracy, or r2, on the rows held out; on the others where there are none."""
        n, found, total, squares = sums[0] if sums[0][0] else sums[1]
        if self.classes:
            return found / n
        spread = squares - total**2 / n
        return 1 - found / spread if spread > 0 else -found

    def run(self, one_round) -> tuple[np.ndarray, list[float]]:
        """(best weights, score before every round). ``one_round(state, number)`` gives the sums over all blocks."""
        flat = first_weights(self.layers, self.seed)
        state = (flat, np.zeros_like(flat), np.zeros_like(flat), 0.0)
        best, top, stale, scores = flat, -np.inf, 0, []
        for round_ in range(self.rounds + 1):
            rows, *after, sums = one_round(state, round_)
            scores.append(self.score(sums))
            stale = 0 if scores[-1] > top + self.tol else stale + 1
            if scores[-1] > top:
                best, top = state[0], scores[-1]
            if stale >= self.patience or not rows:
                break
            state = tuple(v / rows for v in after)
        return best, scores


def train(blocks: DataFrame, size: int, single: bool, training: Training) -> tuple[np.ndarray, list[float]]:
    if not single:
        return training.run(lambda state, round_: block_sums(
            blocks, size, lambda x, y, block: {0: training.block_round(state, round_, x, y, block)})[0])

    def alone(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                x, y, block = unpacked(body, size)
                found = training.run(lambda state, round_: training.block_round(state, round_, x, y, block))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found, protocol=5)], pa.binary())], ["body"])

    return pickle.loads(blocks.mapInArrow(alone, "body binary").first()["body"])


class NeuralNetwork(Estimator, _NetworkParams):
    """Rectified hidden layers; shares of classes, or a number, whose label is standardized for the fit."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, numClasses=None, hidden=None, maxIter=None, batchRows=None,
                 stepSize=None, penalty=None, heldOut=None, patience=None, tol=None, seed=None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "NeuralNetworkModel":
        get = {p.name: self.getOrDefault(p) for p in self.params}
        blocks, size = row_blocks(df, get["featuresCol"], get["labelCol"])
        rows, total, squares, count = (float(v) for v in block_sums(blocks, size, lambda x, y, _: {
            0: tuple(np.array(float(v)) for v in (len(y), y.sum(), (y * y).sum(), 1))}).get(0, (0,) * 4))
        classes = max(2, get["numClasses"]) if get["numClasses"] else 0
        mean = total / rows if rows and not classes else 0.0
        scale = np.sqrt(max(0.0, squares / rows - mean**2)) if rows and not classes else 1.0
        layers = [size, *get["hidden"], classes or 1]
        training = Training(layers, classes, mean, float(scale) or 1.0, get["maxIter"], get["batchRows"], get["stepSize"],
                            get["penalty"], get["heldOut"], get["patience"], get["tol"], get["seed"])
        flat, scores = train(blocks, size, count == 1, training) if rows else (first_weights(layers, get["seed"]), [])
        return self._copyValues(NeuralNetworkModel({
            "weights": flat, "layers": np.array(layers, float), "label": np.array([training.mean, training.scale]),
            "scores": np.array(scores, float)}))


class NeuralNetworkModel(ArraysModel, _NetworkParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and for classes ``probability``. Ties go to the lower class."""
        flat, layers = self.arrays["weights"], [int(n) for n in self.arrays["layers"]]
        mean, scale = self.arrays["label"].tolist()
        classes = self.getOrDefault("numClasses")
        found = row_outputs(df, self.getOrDefault("featuresCol"), lambda x: outputs(flat, layers, x, classes)[-1])
        if not classes:
            return found.withColumn("prediction", F.col("__out")[0] * scale + mean).drop("__out")
        best = F.array_position("__out", F.array_max("__out")) - 1
        return found.withColumns({"probability": array_to_vector("__out"), "prediction": best.cast("double")}).drop("__out")
