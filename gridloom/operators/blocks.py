"""Training rows as blocks of numbers, sums over all blocks, and models that are a few arrays."""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import scratch_path

BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 1 << 25


def _pack(size: int):
    def run(batches):
        held, rows = [], 0

        def block():
            table = np.concatenate(held)
            # Rows of a block stand in an order of their own, whatever order a shuffle brought them in.
            table = table[np.lexsort(table.T[::-1])]
            return pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            held.append(np.column_stack([x, batch.column("label").to_numpy(zero_copy_only=False)]).astype(float))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS or rows * (size + 1) * 8 >= BLOCK_BYTES:
                yield block()
                held, rows = [], 0
        if rows:
            yield block()

    return run


def row_blocks(df: DataFrame, features: str, label: str) -> tuple[DataFrame, int]:
    """(blocks of rows written to the shared folder, number of features). Rows without a label are left out.

    A block holds at most 65,536 rows or 32 MB, and one Arrow batch more. A table that fits in one block is one.
    """
    rows = df.select(vector_to_array(col(features)).alias("f"), col(label).cast("double").alias("label")).where("label is not null")
    first = rows.select(F.size("f")).first()
    size = first[0] if first else 0
    count = rows.count()
    parts = max(1, -(-count // BLOCK_ROWS), -(-count * (size + 1) * 8 // BLOCK_BYTES))
    path = scratch_path(df.sparkSession, "rows")
    rows.coalesce(parts).mapInArrow(_pack(size), "body binary").write.parquet(path)
    return df.sparkSession.read.schema("body binary").parquet(path), size


def unpacked(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, labels, a number that tells the block) of a block."""
    table = np.frombuffer(body, float).reshape(-1, size + 1)
    return table[:, :size], table[:, size], zlib.crc32(body)


def _added(a: dict, b: dict) -> dict:
    return {k: tuple(x + y for x, y in zip(a[k], b[k])) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}


def block_sums(blocks: DataFrame, size: int, step) -> dict[int, tuple]:
    """Sums of ``step(x, y, block number)`` over all blocks: a dict from small numbers to tuples of arrays.

    Tasks add up their blocks; their sums meet in about the square root of as many groups, and those in one group
    per number, so no task and not the driver holds a sum per task of the whole cluster.
    """
    def run(batches):
        total: dict = {}
        key = 0
        for batch in batches:
            for body in batch.column("body").to_pylist():
                x, y, key = unpacked(body, size)
                total = _added(total, step(x, y, key))
        names = list(total)
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.int32()), pa.array([key] * len(names), pa.int64()),
            pa.array([pickle.dumps(total[n], protocol=5) for n in names], pa.binary())], ["name", "task", "body"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["task", "body"])  # one order of adding
        total = None
        for body in rows["body"]:
            found = pickle.loads(body)
            total = found if total is None else tuple(a + b for a, b in zip(total, found))
        return pd.DataFrame({"name": rows["name"].iloc[:1], "task": rows["task"].iloc[:1], "body": [pickle.dumps(total, protocol=5)]})

    schema = "name int, task long, body binary"
    tasks = blocks.rdd.getNumPartitions()
    sums = blocks.mapInArrow(run, schema)
    if tasks > 1:
        fan = math.isqrt(tasks - 1) + 1
        if fan > 4:
            sums = sums.groupBy("name", F.pmod("task", F.lit(fan))).applyInPandas(lambda rows: add(rows), schema)
        sums = sums.groupBy("name").applyInPandas(lambda rows: add(rows), schema)
    return {r["name"]: pickle.loads(r["body"]) for r in sums.collect()}


class ArraysModel(Model, MLWritable, MLReadable):
    """A fitted model whose state is a dict of arrays; saved as its parameters and one row per array."""

    def __init__(self, arrays: dict | None = None):
        super().__init__()
        self._start({})
        self.arrays = arrays or {}

    def write(self):
        return _ArraysWriter(self)

    @classmethod
    def read(cls):
        return _ArraysReader(cls)


class _ArraysWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        rows = [(n, list(a.shape), a.ravel().tolist()) for n, a in self.model.arrays.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, body array<double>").coalesce(1).write.parquet(f"{path}/arrays")


class _ArraysReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/arrays").collect()
        model = self.cls({r["name"]: np.array(r["body"], float).reshape(r["shape"]) for r in rows})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def row_outputs(df: DataFrame, features: str, compute) -> DataFrame:
    """Add ``__out``, an array per row: ``compute`` maps a matrix of features to a matrix, batch by batch."""
    @F.pandas_udf("array<double>")
    def outputs(rows: pd.Series) -> pd.Series:
        return pd.Series(list(compute(np.stack(rows.to_numpy())))) if len(rows) else pd.Series([], dtype=object)

    return df.withColumn("__out", outputs(vector_to_array(col(features))))


def class_codes_checked(y: np.ndarray, classes: int) -> np.ndarray:
    codes = y.astype(np.int64)
    if len(y) and ((codes != y) | (codes < 0) | (codes >= classes)).any():
        raise ValueError(f"a label is no code of {classes} classes")
    return codes
