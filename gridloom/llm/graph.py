"""Connected components of a graph given as pairs of ids: distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attach import attach
from .common import stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and that smallest node, for pairs held in memory."""
    nodes, spots = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = spots[:len(a)], spots[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        # Hook the roots of both ends to the smaller one, then shorten all paths.
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def forest(batches):
    """Arrow batches of pairs (a, b) shrunk to a star forest with the same components."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = local_roots(a, b)
    if len(a):
        a, b = local_roots(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the pairs (a, b); component is its smallest node.

    Each partition first shrinks its pairs to a forest. Then every node sends its larger neighbours, and
    after that its smaller ones, to the least node it knows, until nothing changes: the stars that remain
    are the components. The rounds grow with the logarithm of the longest chain. A node with very many
    neighbours is hot; ``attach`` joins such nodes by broadcast. Loops and repeated pairs change nothing; a
    node whose only pair is a loop is its own component. Nulls are not nodes.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    pairs = stored(pairs, "pairs")
    stars = stored(
        pairs.where("a <> b").mapInArrow(forest, "a long, b long").where("a > b").distinct(), "stars")
    before = None
    while True:
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(2**31))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = attach(both, _least(both), ["a"], "n").where("b > a")
        large = known.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = stored(large, "stars")
        least = _least(large)
        small = attach(large, least, ["a"], "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    parent = stars.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return ends.join(parent, F.col("node") == F.col("__a"), "left").select(
        "node", F.coalesce("__b", "node").alias("component"))
