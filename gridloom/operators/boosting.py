"""Boosted trees on histograms, grown for several training sets and all their classes together.

Features are cut once into at most 256 bins by mergeable quantile sketches; a training set is then a table of
blocks of bin bytes. A level of all trees that are being grown (one per training set and class) is one job:
tasks sum first and second derivatives per tree, node, feature and bin over their blocks, a shuffle by tree
and feature adds them up, and where a feature's sums meet its best cut is chosen, so the driver sees one
proposal per tree and node and task. The first tree counts in full, as in Spark's own boosted trees, later ones by the
learning rate. Derivatives are whole numbers of a fixed scale: sums, and with them
trees, do not depend on how rows are spread. Every few rounds blocks take the new trees into their margins
and are written to the shared folder; a lost executor costs at most those rounds' trees to apply again.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import scratch_path, shared_dir
from .cells import MOST_CELLS, cell_bins, cells_of, drawn_sums

BINS = 256
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 1 << 25
COLUMNS_AT_ONCE = 50  # sketches per aggregation
ACCURACY = 4096  # of a sketch: ranks are right within rows / ACCURACY
WHOLE = float(1 << 30)  # derivatives are multiples of 1 / WHOLE (times the spread of a number to predict)
PENALTY, LEAST_WEIGHT = 1.0, 1.0  # on squared leaf values; second derivatives in a leaf
CELL_GAIN = 4  # rows a cell must hold on average to grow on cells
CELL_BYTES = 1 << 28  # of drawn sums of a training set, all rounds
ROUNDS_KEPT = 10  # trees applied on the fly before margins are written again
REDUCE_BYTES = 1 << 22  # of histograms per reducing task


@dataclass
class Tree:
    """Nodes in heap order: ``feature`` -1 is a leaf; bin <= ``cut`` (value <= ``threshold``) goes left."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> "Tree":
        inner, nodes = (1 << depth) - 1, (2 << depth) - 1
        return cls(np.full(nodes, -1, np.int32), np.zeros(inner, np.int32), np.zeros(inner), np.zeros(nodes))

    def leaves(self, table: np.ndarray, by_bin: bool) -> np.ndarray:
        """The node every row of bins (or values) ends in."""
        at = np.zeros(len(table), np.int64)
        limit = self.cut if by_bin else self.threshold
        while True:
            feature = self.feature[at]
            rows = np.flatnonzero(feature >= 0)
            if not len(rows):
                return at
            here = at[rows]
            # not (value <= limit): a missing number goes right, as its bin is the last
            right = ~(table[rows, feature[rows]] <= limit[here])
            at[rows] = 2 * here + 1 + right


def derivatives(margins: np.ndarray, y: np.ndarray, classes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives per row and tree as whole numbers."""
    if classes == 0:
        first, second = margins - y[:, None], np.ones_like(margins)
        return np.rint(first / scale * WHOLE).astype(np.int64), np.rint(second * WHOLE).astype(np.int64)
    if classes <= 2:
        p = 1 / (1 + np.exp(-margins))
        target = (y == 1)[:, None]
    else:
        e = np.exp(margins - margins.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        target = y[:, None] == np.arange(classes)
    return np.rint((p - target) * WHOLE).astype(np.int64), np.rint(p * (1 - p) * WHOLE).astype(np.int64)


def best_cuts(sums: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, ...]:
    """For (2, nodes, bins) sums of one feature: per node gain, cut, and the sums left and in all. Ties to the lowest cut."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:]
    g, h = left[0] / WHOLE, left[1] / WHOLE
    all_g, all_h = total[0] / WHOLE, total[1] / WHOLE
    gain = g * g / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
    gain = np.where((h >= least) & (all_h - h >= least), gain, -np.inf)[:, :-1]
    cut = gain.argmax(1)
    at = np.arange(len(cut))
    return gain[at, cut], cut, left[0, at, cut], left[1, at, cut], total[0, :, 0], total[1, :, 0]


def better(a: tuple, b: tuple) -> tuple:
    """Of two proposals (feature per node, then as ``best_cuts``) the larger gain of every node, ties to the lower feature."""
    take = (b[1] > a[1]) | ((b[1] == a[1]) & (b[0] < a[0]))
    return tuple(np.where(take, y, x) for x, y in zip(a, b))


def feature_cuts(df: DataFrame, size: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of every element of ``features`` but the last one."""
    values = df.select(vector_to_array("features").alias("f"))
    wanted = [(i + 1) / bins for i in range(bins - 1)]
    cuts = []
    for first in range(0, size, COLUMNS_AT_ONCE):
        some = range(first, min(size, first + COLUMNS_AT_ONCE))
        row = values.agg(*[
            F.struct(F.percentile_approx(F.col("f")[i], wanted, ACCURACY).alias("q"), F.max(F.col("f")[i]).alias("top")).alias(f"c{i}")
            for i in some]).first()
        for i in some:
            found = np.unique(np.array(row[f"c{i}"]["q"] or [], float))
            # Nothing is above the largest value, but missing numbers are.
            cuts.append(found[~(found == row[f"c{i}"]["top"]) & ~np.isnan(found)])
    return cuts


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8) \
        if cuts else np.zeros((len(x), 0), np.uint8)


def _pack(number: int, cuts: list[np.ndarray]):
    """Rows as blocks of bins and labels."""
    def run(batches):
        held_x, held_y, rows = [], [], 0

        def block():
            body = pickle.dumps((np.concatenate(held_x), np.concatenate(held_y)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([body], pa.binary())], ["number", "body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("f").flatten().to_numpy(zero_copy_only=False)
            held_x.append(binned(flat.reshape(batch.num_rows, -1), cuts))
            held_y.append(batch.column("label").to_numpy())
            rows += batch.num_rows
            if rows >= BLOCK_ROWS or rows * max(1, len(cuts)) >= BLOCK_BYTES:
                yield block()
                held_x, held_y, rows = [], [], 0
        if rows:
            yield block()

    return run


def _unpack(row):
    x, y = pickle.loads(row["body"])
    return row["number"], x, y, zlib.crc32(row["body"])


def _with_trees(margins: np.ndarray, x: np.ndarray, rounds: list) -> np.ndarray:
    for trees in rounds:
        for c, tree in enumerate(trees):
            margins[:, c] += tree.value[tree.leaves(x, True)]
    return margins


def _histograms(step: dict, seed: int, sampled: float, classes: int):
    """Map side: sums per (training set, tree, feature) over the blocks of a task.

    ``step`` holds per training set: rounds not yet in the margins, the growing trees, their features and
    open nodes, the scale, and the number of the round.
    """
    def run(blocks):
        sums: dict = {}
        for number, x, y, key, margins in blocks:
            pending, trees, features, open_nodes, scale, round_ = step[number]
            if not any(len(o) for o in open_nodes):
                continue
            margins = _with_trees(margins.copy(), x, pending)
            first, second = derivatives(margins, y, classes, scale)
            drawn = _sampled(seed, sampled)(number, round_, key, len(y))
            for name, found in _node_sums(number, x, first, second, drawn, trees, features, open_nodes):
                sums[name] = sums[name] + found if name in sums else found
        return iter(sums.items())

    return run


def _sampled(seed: int, share: float):
    """Which rows of a block a round draws."""
    return lambda number, round_, key, n: np.random.default_rng([seed, number, round_, key]).random(n) < share


def _node_sums(number: int, x, first, second, drawn, trees, features, open_nodes):
    """((training set, tree, feature), sums per open node and bin) over rows of bins."""
    for c, tree in enumerate(trees):
        if not len(open_nodes[c]):
            continue
        slot = np.full(len(tree.value), -1)
        slot[open_nodes[c]] = np.arange(len(open_nodes[c]))
        at = slot[tree.leaves(x, True)]
        rows = np.flatnonzero(drawn & (at >= 0))
        base, size = at[rows] * BINS, len(open_nodes[c]) * BINS
        g, h = first[rows, c].astype(float), second[rows, c].astype(float)
        for f in features[c]:
            place = base + x[rows, f]
            # Whole numbers below 2^53 add exactly in doubles.
            yield (number, c, int(f)), np.stack([np.bincount(place, g, size), np.bincount(place, h, size)]).astype(np.int64)


def cell_derivatives(margins: np.ndarray, sums: np.ndarray, start: np.ndarray, classes: int, scale: float) -> tuple:
    """First and second derivatives per cell and tree, added over its drawn rows (``sums`` as ``drawn_sums`` gives them)."""
    if classes == 0:
        n, labels = sums[0][:, None], sums[1][:, None]
        return np.rint((margins - start) / scale * n * WHOLE).astype(np.int64) - labels, np.rint(n * WHOLE).astype(np.int64)
    first, second = 0, 0
    for label, n in enumerate(sums):
        g, h = derivatives(margins, np.full(len(margins), float(label)), classes, scale)
        first, second = first + n[:, None] * g, second + n[:, None] * h
    return first, second


def _proposals(penalty: float, least: float):
    """Reduce side: the best proposal per tree among the features that met in this task."""
    def run(items):
        best: dict = {}
        for (number, c, f), sums in items:
            found = best_cuts(sums.reshape(2, -1, BINS), penalty, least)
            offer = (np.full(len(found[0]), f), *found)
            best[number, c] = better(best[number, c], offer) if (number, c) in best else offer
        return iter(best.items())

    return run


class _BoostParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes, or 0 for a number", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "rows drawn for a tree", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "features drawn for a tree", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def _start(self, given: dict):
        self._setDefault(featuresCol="features", labelCol="label", numClasses=0, maxIter=300, maxDepth=6, stepSize=0.1,
                         subsamplingRate=0.8, columnRate=0.8, seed=42)
        self._set(**{k: v for k, v in given.items() if v is not None})


class BoostedTrees(Estimator, _BoostParams):
    """Gradient boosting for numbers, two classes (logistic) or more (softmax)."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, numClasses=None, maxIter=None, maxDepth=None, stepSize=None,
                 subsamplingRate=None, columnRate=None, seed=None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "BoostedTreesModel":
        return self.fit_all([df])[0]

    def fit_all(self, sets: list[DataFrame]) -> list["BoostedTreesModel"]:
        """One model per training set, all grown together."""
        get = {p.name: self.getOrDefault(p) for p in self.params}
        rows = [df.select(col(get["featuresCol"]).alias("features"), col(get["labelCol"]).cast("double").alias("label")) for df in sets]
        found = grow(rows, get["numClasses"], get["maxIter"], get["maxDepth"], get["stepSize"], get["subsamplingRate"],
                     get["columnRate"], get["seed"])
        return [self._copyValues(BoostedTreesModel(base, trees)) for base, trees in found]


def _starts(df: DataFrame, classes: int) -> tuple[np.ndarray, float, int]:
    """Margins before the first tree, the scale of the derivatives, and the number of rows."""
    if classes == 0:
        mean, low, high, n = df.agg(F.avg("label"), F.min("label"), F.max("label"), F.count("label")).first()
        return (np.array([mean]), (high - low) or 1.0, n) if n else (np.zeros(1), 1.0, 0)
    counts = np.ones(max(2, classes))  # one row of every class is assumed, so none is impossible
    for label, n in df.groupBy("label").count().collect():
        if label != int(label) or not 0 <= label < len(counts):
            raise ValueError(f"the label {label} is no code of {len(counts)} classes")
        counts[int(label)] += n
    share = np.log(counts / counts.sum())
    return (share[1:] - share[0] if classes <= 2 else share), 1.0, int(counts.sum()) - len(counts)


def whole_labels(start: np.ndarray, scale: float):
    """Labels to predict as whole numbers, measured from their mean."""
    return lambda y: np.rint((y - start[0]) / scale * WHOLE)


@dataclass
class _Plan:
    """What growing needs to know besides the blocks: values of the fit, and per training set its own."""

    classes: int
    rounds: int
    depth: int
    rate: float
    sampled: float
    columns: float
    seed: int
    sets: dict  # number: (margins at the start, scale, cuts)

    def grow(self, propose, advance) -> dict:
        """Trees per round and class of every set. ``propose(step, bytes of sums)`` gives the proposals of a level,
        ``advance(rounds)`` takes finished rounds into the margins."""
        grown: dict = {s: [] for s in self.sets}
        pending: dict = {s: [] for s in self.sets}
        slots = [(s, c) for s, (start, _, _) in self.sets.items() for c in range(len(start))]
        for round_ in range(self.rounds):
            drawn, trees, opened = ({s: [] for s in self.sets} for _ in range(3))
            for s, c in slots:
                drawn[s].append(_features(len(self.sets[s][2]), self.columns, [self.seed, s, round_, c]))
                trees[s].append(Tree.blank(self.depth))
                opened[s].append(np.zeros(1, np.int64))
            for level in range(self.depth):
                size = sum(16 * BINS * len(opened[s][c]) * len(drawn[s][c]) for s, c in slots)
                if not size:
                    break
                step = {s: (pending[s], trees[s], drawn[s], opened[s], self.sets[s][1], round_) for s in self.sets}
                best = propose(step, size)
                for s, c in slots:
                    _, scale, cuts = self.sets[s]
                    opened[s][c] = _split(
                        trees[s][c], opened[s][c], best.get((s, c)), cuts, self.rate if round_ else 1.0, scale,
                        level + 1 < self.depth)
            for s in self.sets:
                grown[s].append(trees[s])
                pending[s].append(trees[s])
            if (round_ + 1) % ROUNDS_KEPT == 0 and round_ + 1 < self.rounds:
                advance(pending)
                pending = {s: [] for s in self.sets}
        return grown


def _advanced(block: tuple, rounds: dict) -> tuple:
    number, x, y, key, margins = block
    return number, x, y, key, _with_trees(margins.copy(), x, rounds[number])


def _grow_in_task(plan: _Plan, block: tuple) -> dict:
    """All rounds of a training set that is one block."""
    held = [block]

    def propose(step, _):
        return dict(_proposals(PENALTY, LEAST_WEIGHT)(_histograms(step, plan.seed, plan.sampled, plan.classes)(held)))

    def advance(rounds):
        held[0] = _advanced(held[0], rounds)

    return plan.grow(propose, advance)


def _grow_on_cells(plan: _Plan, number: int, x: np.ndarray, sums: dict) -> dict:
    """All rounds of a training set from its cells ``x`` and the drawn ``sums`` of every round."""
    start, scale, _ = plan.sets[number]
    held = [np.tile(start, (len(x), 1))]

    def propose(step, _):
        pending, trees, features, open_nodes, _, round_ = step[number]
        drawn = sums[round_]
        margins = _with_trees(held[0].copy(), x, pending)
        first, second = cell_derivatives(margins, drawn, start, plan.classes, scale)
        any_drawn = (drawn.sum(0) if plan.classes else drawn[0]) > 0
        found = _node_sums(number, x, first, second, any_drawn, trees, features, open_nodes)
        return dict(_proposals(PENALTY, LEAST_WEIGHT)(found))

    def advance(rounds):
        held[0] = _with_trees(held[0].copy(), x, rounds[number])

    return plan.grow(propose, advance)


def _cells_in_task(plans: dict, cells, sizes: dict):
    def run(items):
        sums: dict = {}
        for number, (round_, found) in items:
            sums.setdefault(number, {})[round_] = found
        for number, rounds in sums.items():
            yield _grow_on_cells(plans[number], number, cell_bins(cells.value[number], sizes[number]), rounds)

    return run


def _grow_by_jobs(plan: _Plan, state) -> dict:
    """A job per level for all training sets of ``plan`` together."""
    held = [_kept(state)]
    most = 4 * state.context.defaultParallelism

    def propose(step, size):
        reducers = max(1, min(-(-size // REDUCE_BYTES), most))
        sums = held[0].mapPartitions(_histograms(step, plan.seed, plan.sampled, plan.classes)).reduceByKey(np.add, reducers)
        best: dict = {}
        for name, offer in sums.mapPartitions(_proposals(PENALTY, LEAST_WEIGHT)).collect():
            best[name] = better(best[name], offer) if name in best else offer
        return best

    def advance(rounds):
        before, held[0] = held[0], _kept(held[0].map(lambda block: _advanced(block, rounds)))
        before.unpersist()

    try:
        return plan.grow(propose, advance)
    finally:
        held[0].unpersist()


@dataclass
class Packed:
    """Training sets as a table of blocks of bins and labels.

    ``about`` holds per set the margins at the start, the scale and the cuts, ``rows`` their number; ``several`` names
    the sets of more than one block.
    """

    about: dict
    rows: dict
    several: list
    blocks: DataFrame

    def chosen(self, numbers):
        """An RDD of (set, bins, labels, key) of the blocks of some sets."""
        return self.blocks.where(F.col("number").isin(numbers)).rdd.map(_unpack)


def binned_blocks(sets: list[DataFrame], classes: int, bins: int = BINS) -> Packed:
    """Sets of rows (features, label) cut into bins and written once."""
    spark = sets[0].sparkSession
    shared_dir(spark)
    about, rows, several, path = {}, {}, [], scratch_path(spark, "blocks")
    for number, df in enumerate(sets):
        first = df.select(F.size(vector_to_array("features"))).first()
        size = first[0] if first else 0
        cuts = feature_cuts(df, size, bins)
        start, scale, count = _starts(df, classes)
        about[number], rows[number] = (start, scale, cuts), count
        parts = max(1, -(-count // BLOCK_ROWS), -(-count * size // BLOCK_BYTES))
        if parts > 1:
            several.append(number)
        narrow = df.select(vector_to_array("features").alias("f"), "label").coalesce(parts)
        narrow.mapInArrow(_pack(number, cuts), "number int, body binary").write.mode("append").parquet(path)
    return Packed(about, rows, several, spark.read.schema("number int, body binary").parquet(path))


def grow(sets: list[DataFrame], classes: int, rounds: int, depth: int, rate: float, sampled: float, columns: float,
         seed: int) -> list[tuple[np.ndarray, list[list[Tree]]]]:
    """(margins at the start, trees per round and class) of every set of rows (features, label).

    Training sets of several blocks share a job per level. One that is a single block (its size is known before)
    is grown by the task that holds it, by the same sums and choices, without a job per level. So is one whose rows
    agree in so many bins that its cells are few: one job draws the rows of all rounds and adds them up per cell.
    """
    packed = binned_blocks(sets, classes)
    about, several = packed.about, packed.several
    starts = {n: start for n, (start, _, _) in about.items()}

    def chosen(numbers):
        return packed.chosen(numbers).map(lambda b: (*b, np.tile(starts[b[0]], (len(b[1]), 1))))

    def plan(numbers):
        return _Plan(classes, rounds, depth, rate, sampled, columns, seed, {n: about[n] for n in numbers})

    grown: dict = {n: [] for n in about}  # a set without rows gets no trees
    single = [n for n in about if n not in several]
    if single:
        plans = {n: plan([n]) for n in single}
        spread = chosen(single).keyBy(lambda b: b[0]).partitionBy(len(single), lambda n: single.index(n)).values()
        for found in spread.map(lambda b: _grow_in_task(plans[b[0]], b)).collect():
            grown |= found
    if several and rounds:
        sizes = {n: len(about[n][2]) for n in several}
        most = {n: min(MOST_CELLS, packed.rows[n] // CELL_GAIN, CELL_BYTES // (8 * rounds * (classes or 2))) for n in several}
        cells = cells_of(packed.blocks.where(F.col("number").isin(several)), sizes, most)
        if cells:
            shared = sets[0].sparkSession.sparkContext.broadcast(cells)  # at most MOST_CELLS rows of bins a set
            whole = {n: whole_labels(*about[n][:2]) for n in cells} if not classes else {}
            few = sorted(cells)
            sums = drawn_sums(packed.chosen(few), sum(packed.rows[n] for n in few), shared, whole, classes, rounds, _sampled(seed, sampled))
            by_set = sums.map(lambda item: (item[0][0], (item[0][1], item[1]))).partitionBy(len(few), lambda n: few.index(n))
            for found in by_set.mapPartitions(_cells_in_task({n: plan([n]) for n in few}, shared, sizes)).collect():
                grown |= found
            shared.unpersist()
        several = [n for n in several if n not in cells]
    if several:
        grown |= _grow_by_jobs(plan(several), chosen(several))
    return [(starts[n], grown[n]) for n in about]


def _kept(state):
    """Written to the shared folder, and held by executors while they live."""
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    state.count()
    return state


def _features(size: int, share: float, seed: list) -> np.ndarray:
    count = min(size, max(1, round(size * share)))
    return np.sort(np.random.default_rng(seed).choice(size, count, replace=False)) if size else np.zeros(0, np.int64)


def _split(tree: Tree, opened: np.ndarray, offer, cuts: list, rate: float, scale: float, deeper: bool) -> np.ndarray:
    """Put the chosen cuts into the tree; returns the nodes to look at next."""
    if offer is None:
        return opened[:0]
    feature, gain, cut, left_g, left_h, all_g, all_h = offer

    def leaf(g, h):
        return -rate * scale * (g / WHOLE) / (h / WHOLE + PENALTY)

    later = []
    for i, node in enumerate(opened.tolist()):
        if node == 0:
            tree.value[0] = leaf(all_g[i], all_h[i])
        if not gain[i] > 1e-12:
            continue
        tree.feature[node], tree.cut[node] = feature[i], cut[i]
        tree.threshold[node] = cuts[feature[i]][cut[i]]
        tree.value[2 * node + 1] = leaf(left_g[i], left_h[i])
        tree.value[2 * node + 2] = leaf(all_g[i] - left_g[i], all_h[i] - left_h[i])
        if deeper:
            later += [2 * node + 1, 2 * node + 2]
    return np.array(later, np.int64)


class BoostedTreesModel(Model, _BoostParams, MLWritable, MLReadable):
    def __init__(self, base: np.ndarray | None = None, trees: list | None = None):
        super().__init__()
        self._start({})
        self.base, self.trees = base, trees

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and for classes ``probability``."""
        base, trees = self.base, self.trees

        @F.pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 0))
            out = np.tile(base, (len(x), 1))
            for round_ in trees:
                for c, tree in enumerate(round_):
                    out[:, c] += tree.value[tree.leaves(x, False)]
            return pd.Series(list(out))

        found = df.withColumn("__margins", margins(vector_to_array(col(self.getOrDefault(self.featuresCol)))))
        classes = self.getOrDefault(self.numClasses)
        m = F.col("__margins")
        if classes == 0:
            return found.withColumn("prediction", m[0]).drop("__margins")
        if classes <= 2:
            p = 1 / (1 + F.exp(-m[0]))
            share = F.array(1 - p, p)
        else:
            e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
            share = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        found = found.withColumn("__share", share)
        best = F.array_position("__share", F.array_max("__share")) - 1
        return found.withColumns({"probability": array_to_vector("__share"), "prediction": best.cast("double")}).drop(
            "__margins", "__share")

    def write(self):
        return _BoostWriter(self)

    @classmethod
    def read(cls):
        return _BoostReader(cls)


class _BoostWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, model = SparkSession.active(), self.model
        DefaultParamsWriter.saveMetadata(model, path, spark)
        rows = [(r, c, t.feature.tolist(), t.cut.tolist(), t.threshold.tolist(), t.value.tolist(), float(model.base[c]))
                for r, trees in enumerate(model.trees) for c, t in enumerate(trees)]
        spark.createDataFrame(rows, "round int, tree int, feature array<int>, cut array<int>, threshold array<double>, "
                              "value array<double>, base double").coalesce(1).write.parquet(f"{path}/trees")


class _BoostReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        trees: list = []
        base: dict = {}
        for r in spark.read.parquet(f"{path}/trees").orderBy("round", "tree").collect():
            if r["round"] == len(trees):
                trees.append([])
            trees[-1].append(Tree(np.array(r["feature"], np.int32), np.array(r["cut"], np.int32),
                                  np.array(r["threshold"], float), np.array(r["value"], float)))
            base[r["tree"]] = r["base"]
        model = BoostedTreesModel(np.array([base[c] for c in sorted(base)]), trees)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
