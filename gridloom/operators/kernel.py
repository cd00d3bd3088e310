"""Support vectors with a Gaussian kernel, for classes and for numbers.

The kernel is replaced by random Fourier features (cosines and sines along random directions), so a fit is
linear in the rows and holds no kernel matrix. The primal problem with squared hinge loss (squared
insensitive loss for numbers) is solved by Newton steps; a step is one pass that sums loss, gradient and
second derivatives over all rows, for all classes together as far as their sums stay within 64 MB.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ArraysModel, block_sums, class_codes_checked, row_blocks, row_outputs

SUM_BYTES = 1 << 26  # of second derivatives per pass


class _KernelParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes, or 0 to predict a number", TypeConverters.toInt)
    directions = Param(Params._dummy(), "directions", "random directions, each a cosine and a sine", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "1 / squared width; 0 for 1 / (features * their variance)", TypeConverters.toFloat)
    cost = Param(Params._dummy(), "cost", "weight of the losses against the squared weights", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to it are free, in deviations of the label", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "Newton steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "relative gain of the objective that ends the fit", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the directions", TypeConverters.toInt)

    def _start(self, given: dict):
        self._setDefault(featuresCol="features", labelCol="label", numClasses=0, directions=128, gamma=0.0, cost=1.0,
                         epsilon=0.1, maxIter=100, tol=1e-8, seed=42)
        self._set(**{k: v for k, v in given.items() if v is not None})


def mapped(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Random Fourier features; products of two mapped rows are near exp(-gamma * squared distance). Last stands a 1."""
    angles = x @ directions
    scale = 1 / np.sqrt(max(1, directions.shape[1]))
    return np.column_stack([np.cos(angles) * scale, np.sin(angles) * scale, np.ones(len(x))])


def losses(z: np.ndarray, target: np.ndarray, weights: np.ndarray, epsilon: float | None) -> tuple:
    """(loss, gradient, second derivatives) of one problem over rows ``z``; ``epsilon`` None: targets are -1 and 1."""
    f = z @ weights
    if epsilon is None:
        slack, slope = 1 - target * f, -target
    else:
        slack, slope = np.abs(f - target) - epsilon, np.sign(f - target)
    active = slack > 0
    z, slack, slope = z[active], slack[active], slope[active]
    return np.array(slack @ slack), 2 * z.T @ (slack * slope), 2 * z.T @ z


class _Problem:
    """Newton's method with halved steps on one weight vector; the bias, the last weight, is free."""

    def __init__(self, size: int, cost: float, tol: float):
        self.best = self.trial = np.zeros(size)
        self.free = np.ones(size)
        self.free[-1] = 1e-9
        self.cost, self.tol = cost, tol
        self.value, self.done, self.step = np.inf, False, None

    def take(self, loss, gradient, curvature) -> None:
        value = 0.5 * self.free @ self.trial**2 + self.cost * float(loss)
        if value > self.value:
            self.step = self.step / 2
            self.done = np.abs(self.step).max() < 1e-12
            self.trial = self.best + self.step
            return
        self.done = self.value - value <= self.tol * max(1.0, abs(value))
        self.best, self.value = self.trial, value
        slope = self.free * self.best + self.cost * gradient
        self.step = -np.linalg.solve(np.diag(self.free) + self.cost * curvature, slope)
        self.trial = self.best + self.step


class KernelMachine(Estimator, _KernelParams):
    """Support vectors with a Gaussian kernel; more than two classes are told apart one against the rest."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, numClasses=None, directions=None, gamma=None, cost=None,
                 epsilon=None, maxIter=None, tol=None, seed=None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KernelMachineModel":
        get = {p.name: self.getOrDefault(p) for p in self.params}
        classes = get["numClasses"]
        blocks, size = row_blocks(df, get["featuresCol"], get["labelCol"])

        def moments(x, y, _):
            return {0: tuple(np.array(float(v)) for v in (x.size, x.sum(), (x * x).sum(), len(y), y.sum(), (y * y).sum()))}

        cells, total, squares, rows, label_sum, label_squares = (
            float(v) for v in block_sums(blocks, size, moments).get(0, (0,) * 6))
        spread = squares / cells - (total / cells) ** 2 if cells else 0.0
        gamma = get["gamma"] or (1 / (size * spread) if spread > 0 else 1.0)
        directions = np.random.default_rng(get["seed"]).normal(size=(size, get["directions"])) * np.sqrt(2 * gamma)
        mean = label_sum / rows if rows and not classes else 0.0
        scale = np.sqrt(max(0.0, label_squares / rows - mean**2)) if rows and not classes else 1.0
        scale = scale or 1.0
        epsilon = None if classes else get["epsilon"]

        def target(y, k):
            if not classes:
                return (y - mean) / scale
            return np.where(class_codes_checked(y, max(2, classes)) == k, 1.0, -1.0)

        width = 2 * get["directions"] + 1
        codes = [0] if not classes else [1] if classes <= 2 else list(range(classes))
        problems = {k: _Problem(width, get["cost"], get["tol"]) for k in codes}
        together = max(1, SUM_BYTES // (8 * width * width))
        for first in range(0, len(codes), together):
            for _ in range(get["maxIter"]):
                trials = {k: problems[k].trial for k in codes[first:first + together] if not problems[k].done}
                if not trials or not rows:
                    break

                def step(x, y, _):
                    z = mapped(x, directions)
                    return {k: losses(z, target(y, k), w, epsilon) for k, w in trials.items()}

                for k, found in block_sums(blocks, size, step).items():
                    problems[k].take(*found)
        weights = np.column_stack([problems[k].best for k in codes])
        return self._copyValues(KernelMachineModel({
            "directions": directions, "weights": weights, "label": np.array([mean, scale])}))


class KernelMachineModel(ArraysModel, _KernelParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and for classes ``rawPrediction``, the margins. Ties go to the lower class."""
        directions, weights = self.arrays["directions"], self.arrays["weights"]
        mean, scale = self.arrays["label"].tolist()
        classes = self.getOrDefault("numClasses")
        found = row_outputs(df, self.getOrDefault("featuresCol"), lambda x: mapped(x, directions) @ weights)
        out = F.col("__out")
        if not classes:
            return found.withColumn("prediction", out[0] * scale + mean).drop("__out")
        if classes <= 2:
            found = found.withColumn("__out", F.array(-out[0], out[0]))
        best = F.array_position("__out", F.array_max("__out")) - 1
        return found.withColumns({"rawPrediction": array_to_vector("__out"), "prediction": best.cast("double")}).drop("__out")
