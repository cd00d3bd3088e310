"""Quality classifier: a byte-level convolutional network in numpy.

Input channels of a byte: a learned embedding and one flag that says whether the bytes around repeat at a
short distance. Learned filters run over overlapping chunks that cover the whole document, their
outputs are max-pooled over all chunks, and a logistic layer joins the maxima into one probability.
Training follows the gradient only through the chunks that won the pooling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .common import byte_view, hand_back, lean, spans_of, text_or_empty
from .tokens import release

BLOCK = 8  # bytes a chunk moves on by; a chunk spans two blocks
DEPTH = 6  # learned channels per byte
FILTERS = 32
LAGS = range(1, 25)  # distances at which repetition is looked for
RUN = 16  # bytes that must repeat
PAD = 256  # code after the end of a document
MAX_TRAINING_ROWS = 4_000  # documented bound of the training sample
MAX_TRAINING_BYTES = 24 << 20  # and of its text; rows are taken in hashed order up to it
STEP_BYTES = 1 << 19


def repetition(codes: np.ndarray) -> np.ndarray:
    """1 where a run of RUN bytes that covers the byte equals the bytes a short distance before."""
    found = np.zeros(len(codes), np.uint8)
    for lag in LAGS:
        if len(codes) < RUN + lag:
            break
        run = (codes[lag:] == codes[:-lag]).view(np.uint8)
        for step in (1, 2, 4, 8):
            run = run[:-step] & run[step:]
        found[lag:lag + len(run)] |= run
    for step in (1, 2, 4, 8):  # mark the whole run, not its start alone
        found[step:] |= found[:-step].copy()
    return found


def lay_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts in whole blocks, each text followed by an empty block; first block and number of chunks."""
    sizes = np.diff(at)
    chunks = np.maximum(1, -(-sizes // BLOCK))
    ends = np.cumsum(chunks + 1)
    first = ends - chunks - 1
    codes = np.full(int(ends[-1]) * BLOCK, PAD, np.int16)
    for i in range(len(sizes)):
        codes[first[i] * BLOCK:first[i] * BLOCK + sizes[i]] = data[at[i]:at[i + 1]]
    return codes, first, chunks


@dataclass
class Network:
    embedding: np.ndarray  # (257, DEPTH)
    filters: np.ndarray  # (2, BLOCK * (DEPTH + 1), FILTERS): the two blocks of a chunk
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (FILTERS,)
    offset: np.ndarray  # (1,)

    def blocks(self, codes: np.ndarray) -> np.ndarray:
        x = np.empty((len(codes), DEPTH + 1), np.float32)
        x[:, :DEPTH] = self.embedding[codes]
        x[:, DEPTH] = repetition(codes) * (codes != PAD)
        return x.reshape(-1, BLOCK * (DEPTH + 1))

    def responses(self, x: np.ndarray) -> np.ndarray:
        both = x @ np.concatenate([self.filters[0], self.filters[1]], axis=1)
        out = both[:, :FILTERS] + self.bias
        out[:-1] += both[1:, FILTERS:]
        return out

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        result = np.empty(len(at) - 1)
        for begin, end in spans_of(at, STEP_BYTES):
            codes, first, chunks = lay_out(data, at[begin:end + 1])
            out = self.responses(self.blocks(codes))
            out[first + chunks] = -np.inf  # the empty block after a text starts no chunk
            pooled = np.maximum(np.maximum.reduceat(out, first, axis=0), 0)
            result[begin:end] = pooled.astype(np.float64) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(result, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, updates: int = 1300, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by ``updates`` steps of Adam, however large the sample is. With one class alone the network gives that class's frequency."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32),
        rng.normal(0, 0.15, (2, BLOCK * (DEPTH + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32))
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.offset[0] = np.log(share / (1 - share))
    if len(np.unique(labels)) < 2:
        net.weights[:] = 0
        return net
    names = ("embedding", "filters", "bias", "weights", "offset")
    mean = {n: np.zeros_like(getattr(net, n)) for n in names}
    square = {n: np.zeros_like(getattr(net, n)) for n in names}
    laid = []
    for text in texts:
        codes, _, _ = lay_out(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        laid.append((codes, repetition(codes) * (codes != PAD)))
    steps = 0
    while steps < updates:
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), batch):
            if steps == updates:
                break
            chosen = order[begin:begin + batch]
            codes = np.concatenate([laid[i][0] for i in chosen])
            counts = np.array([len(laid[i][0]) // BLOCK for i in chosen])
            first = np.cumsum(counts) - counts
            x = np.empty((len(codes), DEPTH + 1), np.float32)
            x[:, :DEPTH] = net.embedding[codes]
            x[:, DEPTH] = np.concatenate([laid[i][1] for i in chosen])
            x = x.reshape(-1, BLOCK * (DEPTH + 1))
            out = net.responses(x)
            out[first + counts - 1] = -np.inf
            winner = np.stack([out[f:f + c].argmax(0) + f for f, c in zip(first, counts)])
            pooled = np.take_along_axis(out, winner, 0)
            active = pooled > 0
            pooled = np.where(active, pooled, 0)
            probability = 1 / (1 + np.exp(-(pooled @ net.weights + net.offset)))
            error = ((probability - labels[chosen]) / len(chosen)).astype(np.float32)
            back = np.where(active, error[:, None] * net.weights, 0)
            grads = {"weights": pooled.T @ error, "offset": error.sum(keepdims=True), "bias": back.sum(0)}
            grads["filters"] = np.empty_like(net.filters)
            grads["embedding"] = np.zeros_like(net.embedding)
            for half in (0, 1):
                seen = x[winner + half]  # (documents, FILTERS, inputs)
                grads["filters"][half] = np.einsum("dfi,df->if", seen, back)
                inner = (back[:, :, None] * net.filters[half].T).reshape(-1, BLOCK, DEPTH + 1)[:, :, :DEPTH]
                where = ((winner + half).reshape(-1, 1) * BLOCK + np.arange(BLOCK)).ravel()
                np.add.at(grads["embedding"], codes[where], inner.reshape(-1, DEPTH))
            steps += 1
            pace = rate * min(1, steps / 50) * (1 - 0.9 * steps / updates)
            for n in names:
                g = grads[n].reshape(getattr(net, n).shape)
                if n in ("filters", "weights"):
                    g = g + 1e-5 * getattr(net, n)
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.99 * square[n] + 0.01 * g * g
                getattr(net, n)[...] -= pace * (mean[n] / (1 - 0.9**steps)) / (np.sqrt(square[n] / (1 - 0.99**steps)) + 1e-7)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS, size: int = MAX_TRAINING_BYTES):
    """Texts and labels of at most ``rows`` labelled documents that are not held out, in hashed order.

    A document with several labels counts as its largest; null labels do not count. Long documents come
    whole; those that no longer fit into ``size`` bytes together are left out of the sample.
    """
    known = labels.select(col("doc_id").alias("__id"), col("quality").alias("__quality"))
    known = known.where(F.col("__id").isNotNull() & F.col("__quality").isNotNull())
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__quality").alias("__quality"))
    # Ids first: the order and the sizes choose the rows before any text moves.
    sized = docs.select(col("doc_id").alias("__id"), F.octet_length(text_or_empty()).alias("__size"))
    order = F.xxhash64(F.lit(11), "__id")
    first = sized.join(known, "__id").orderBy(order, "__id", "__size").limit(rows).collect()
    chosen, used = {}, 0
    for r in first:
        if used + r["__size"] <= size:
            chosen[r["__id"]] = r["__quality"]
            used += r["__size"]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "__id long")
    found = docs.select(col("doc_id").alias("__id"), text_or_empty().alias("__text")).join(F.broadcast(ids), "__id", "left_semi")
    rows_ = sorted((r["__id"], r["__text"]) for r in found.collect())
    return [t.encode() for _, t in rows_], np.array([chosen[i] for i, _ in rows_], np.float32)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _score(net: Network):
    def run(batches):
        release()
        for batch in batches:
            data, at = byte_view(batch.column("text"))
            scores = pa.array(net.scores(data, at)) if len(batch) else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Inputs: docs with doc_id and text, labels with doc_id and quality; other columns are ignored. Only the
    text enters a score; null counts as empty, and an empty text gets a score too. Equal texts get equal
    scores. Without labels of both classes every score is the smoothed share of label 1. The network is
    fitted on the driver on a bounded sample (``training_sample``) and sent to the tasks (about 60 KB).
    """
    net = train(*training_sample(docs, labels))
    rows = docs.select(
        col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(col("doc_id")), F.lit(False)).alias("held_out"),
        text_or_empty().alias("text"))
    scored = rows.mapInArrow(lean(_score(net)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose text scores at least ``threshold``, with all their columns and no shuffle."""
    net = train(*training_sample(docs, labels))
    score = F.arrow_udf(_column(net), "double")
    return docs.where(score(text_or_empty()) >= threshold)


def _column(net: Network):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for column in texts:  # Arrow's own bytes: no object per text
            yield pa.array(net.scores(*byte_view(column)) if len(column) else [], pa.float64())
        hand_back()

    return run


def query(spark, directory):
    table = lambda name: spark.read.parquet(f"{directory}/{name}.parquet")
    return classify(table("documents"), table("labels"))
