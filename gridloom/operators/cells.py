"""Training sets as cells: rows that agree in the bins of all features, which no tree can tell apart.

A tree needs per cell the number of drawn rows and the sum of their labels. Tasks draw rows for all trees and add up
cells over their blocks, so what is shuffled grows with cells and trees, and no longer with rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

MOST_CELLS = 1 << 16
ROWS_AT_ONCE = 1 << 22  # rows whose cells and labels a task holds


def cell_keys(x: np.ndarray) -> np.ndarray:
    """Rows of bins as fixed-width strings; dropped zeros at the end stand for themselves, as all are equally wide."""
    x = x if x.shape[1] else np.zeros((len(x), 1), np.uint8)
    return np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel()


def cell_bins(keys: np.ndarray, size: int) -> np.ndarray:
    """The bins of cells."""
    return np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), -1)[:, :size]


def _distinct(batches):
    for batch in batches:
        for number, body in zip(batch.column("number").to_pylist(), batch.column("body")):
            keys = np.unique(cell_keys(pickle.loads(body.as_buffer())[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), number, np.int32)), pa.array(keys.tolist(), pa.binary())], ["number", "cell"])


def cells_of(blocks: DataFrame, sizes: dict, most: dict) -> dict:
    """number: the sorted cells of every training set that has no more of them than ``most`` allows."""
    found = checkpointed(blocks.mapInArrow(_distinct, "number int, cell binary").distinct())
    counts = {r["number"]: r["count"] for r in found.groupBy("number").count().collect()}
    few = [n for n, count in counts.items() if n in most and count <= most[n]]
    cells: dict = {n: [] for n in few}
    for r in found.where(F.col("number").isin(few)).collect() if few else []:
        cells[r["number"]].append(bytes(r["cell"]))
    return {n: np.sort(np.array(c, f"S{max(1, sizes[n])}")) for n, c in cells.items()}


def _drawn(cells, whole: dict, classes: int, draws: int, weigh):
    """Map side: per (training set, draw) the rows and label sums of every cell over the blocks of a task."""
    def run(blocks):
        held: dict = {}
        for number, x, y, key in blocks:
            at = np.searchsorted(cells.value[number], cell_keys(x)).astype(np.int32)
            if classes:
                label = y.astype(np.int32)
            else:
                label = whole[number](y)
            held.setdefault(number, []).append((at, label, key))
        for number, parts in held.items():
            size = len(cells.value[number])
            for draw in range(draws):
                sums = np.zeros((classes or 2, size), np.int64)
                for at, label, key in parts:
                    w = weigh(number, draw, key, len(at)).astype(float)
                    # Whole numbers below 2^53 add exactly in doubles.
                    if classes:
                        sums += np.bincount(label * size + at, w, classes * size).reshape(classes, size).astype(np.int64)
                    else:
                        sums[0] += np.bincount(at, w, size).astype(np.int64)
                        sums[1] += np.bincount(at, w * label, size).astype(np.int64)
                yield (number, draw), sums

    return run


def _added(items):
    sums: dict = {}
    for name, some in items:
        sums[name] = sums[name] + some if name in sums else some
    return iter(sums.items())


def drawn_sums(blocks, rows: int, cells, whole: dict, classes: int, draws: int, weigh):
    """((training set, draw), sums) for all draws: per cell, rows and whole labels of a number to predict, or rows per class.

    ``blocks`` is an RDD of (number, bins, labels, key); ``weigh(number, draw, key, rows)`` says how often rows are drawn,
    the same under any spread of the blocks.
    """
    context = blocks.context
    most = 4 * context.defaultParallelism
    parts = max(context.defaultParallelism, -(-rows // ROWS_AT_ONCE))
    numbers = sorted(cells.value)
    names = len(numbers) * draws
    spread = blocks.coalesce(parts) if blocks.getNumPartitions() > parts else blocks
    sums = spread.mapPartitions(_drawn(cells, whole, classes, draws, weigh))
    return sums.partitionBy(min(names, most), lambda name: name[1] * len(numbers) + numbers.index(name[0])).mapPartitions(_added)
