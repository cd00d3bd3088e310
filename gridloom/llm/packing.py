"""Packing documents into sequences by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There large
lengths are rounded up within groups of equal cardinality, the few rounded sizes are packed by an
optimised mix of configurations (column generation), actual pieces take the places of the rounded sizes,
and the rest and all small pieces go best-fit into the smallest gap that holds them. The plan says for
runs of pieces of one length where they go; tasks look the places up by a piece's rank in its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .common import lean, stored, text_or_empty
from .tokens import encoder

CAPACITY = 1024
LARGE_SHARES = (2, 3, 4)  # pieces from capacity / share on are large; the share that needs fewest sequences is used
GROUPS = 64  # rounded sizes at most
ROWS_PER_BIN = 20_000


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _pieces(path: str, end_id: int, capacity: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        words = encoder(path, spaced=True)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            rows = []
            for doc_id, ids in zip(docs, words.encode_column(batch.column("text"))):
                ids += end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(
        lean(_pieces(tokenizer_path, end_id, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[tuple, float]]:
    """How often to use which multiset of sizes so that all demand is met by few sequences.

    The linear relaxation is solved by column generation: prices of the sizes come from the current basis,
    the most valuable multiset by a knapsack table. Returns (counts per size, uses).
    """
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    uses = np.array(demand, float) / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        best, step = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.array(sizes)
        for room in range(min(sizes), capacity + 1):
            fits = bisect_left(sizes, room + 1)
            value = best[room - order[:fits]] + prices[:fits]
            k = int(np.argmax(value))
            best[room], step[room] = best[room - 1], -1
            if value[k] > best[room] + 1e-12:
                best[room], step[room] = value[k], k
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if step[room] < 0:
                room -= 1
            else:
                column[step[room]] += 1
                room -= sizes[step[room]]
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        uses = uses - ratio[leave] * change
        uses[leave] = ratio[leave]
        basis[:, leave] = column
    return [(tuple(int(round(c)) for c in basis[:, j]), float(uses[j])) for j in range(n)]


class _Plan:
    """Runs of sequences with equal content, and which ranks of which length lie where."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(histogram)  # pieces not yet placed, by length
        self.rank = dict.fromkeys(histogram, 0)  # first rank not yet placed, by length
        self.rows = []  # length, first rank, count, first sequence, offset
        self.gaps = [[] for _ in range(capacity + 1)]  # by gap: [first sequence, count]
        self.sequences = 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def open(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def configured(self, slots: list[list[list[int]]], count: int) -> None:
        """``count`` new sequences; ``slots[i]`` holds [length, pieces] runs that fill place i of each."""
        first, done = self.open(count), 0
        heads = [0] * len(slots)
        while done < count:
            width = min(slots[i][heads[i]][1] for i in range(len(slots)))
            offset = 0
            for i, runs in enumerate(slots):
                run = runs[heads[i]]
                self.place(run[0], width, first + done, offset)
                offset += run[0]
                run[1] -= width
                if not run[1]:
                    heads[i] += 1
            self.gaps[self.capacity - offset].append([first + done, width])
            done += width

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            gap = next((g for g in range(length, self.capacity + 1) if self.gaps[g]), None)
            if gap is None:
                each = self.capacity // length
                many = max(1, self.left[length] // each)
                self.gaps[self.capacity].append([self.open(many), many])
                gap = self.capacity
            run = self.gaps[gap][-1]
            count = min(run[1], self.left[length])
            self.place(length, count, run[0], self.capacity - gap)
            self.gaps[gap - length].append([run[0], count])
            run[0] += count
            run[1] -= count
            if not run[1]:
                self.gaps[gap].pop()


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Rows (length, first rank, count, first sequence, offset) that place all pieces, and the number of sequences."""
    plans = (_grouped_plan(histogram, capacity, groups, max(1, capacity // share)) for share in LARGE_SHARES)
    best = min(plans, key=lambda plan: plan.sequences)
    return best.rows, best.sequences


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, least: int) -> _Plan:
    plan = _Plan(histogram, capacity)
    large = sorted((length for length in histogram if length >= least), reverse=True)
    total = sum(histogram[length] for length in large)
    if total:
        share, members, filled = -(-total // groups), [[]], 0
        for length in large:  # equal cardinality: a length that fills its group opens the next
            if filled >= share:
                members.append([])
                filled = 0
            members[-1].append(length)
            filled += histogram[length]
        members.reverse()  # rounded sizes rise
        sizes = [group[0] for group in members]
        demand = [sum(histogram[length] for length in group) for group in members]
        for counts, uses in configurations(sizes, demand, capacity):
            whole = int(uses + 1e-6)
            for k, c in enumerate(counts):  # roundoff must not ask for more than there is
                if c:
                    whole = min(whole, sum(plan.left[x] for x in members[k]) // c)
            if not whole:
                continue
            slots = []  # the longest pieces of a group first
            for k in reversed(range(len(counts))):
                reserved = {}
                for _ in range(counts[k]):
                    runs, need = [], whole
                    for length in members[k]:
                        free = plan.left[length] - reserved.get(length, 0)
                        if need and free:
                            take = min(need, free)
                            runs.append([length, take])
                            reserved[length] = reserved.get(length, 0) + take
                            need -= take
                    slots.append(runs)
            plan.configured(slots, whole)
    for length in sorted(histogram, reverse=True):
        plan.best_fit(length)
    return plan


def _place(starts, sequences, offsets):
    def run(batches):
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            at = np.searchsorted(starts, spot, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in OUTPUT[:5]), pa.array(sequences[at] + spot - starts[at]), pa.array(offsets[at])],
                OUTPUT)

    return run


OUTPUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Input: doc_id, text; other columns are ignored. A null or empty text is one piece that holds the end
    id alone. Longer documents than ``capacity`` are cut; only their first piece may be shorter. Repeated
    rows are packed each. Ties in length are ordered by hash and keys. An empty table gives no rows.
    """
    rows = stored(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    plan, _ = packing_plan(histogram, capacity)
    # A piece's spot: pieces of smaller lengths, then its rank among those of its length. Bins share the ranking.
    lengths = sorted(histogram)
    base = dict(zip(lengths, np.cumsum([0, *(histogram[length] for length in lengths)]).tolist()))
    info = docs.sparkSession.createDataFrame(
        [(length, base[length], -(-histogram[length] // ROWS_PER_BIN)) for length in lengths],
        "__length long, __base long, __bins long")
    binned = rows.join(F.broadcast(info), F.col("length") == F.col("__length")).withColumn(
        "__bin", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__bins")))
    sizes = binned.groupBy("__length", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__length").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__length").alias("__l"), F.col("__bin").alias("__b"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__length", "__bin").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = binned.withColumn("__nth", nth)
    ranked = ranked.join(offsets, (ranked["__length"] == offsets["__l"]) & (ranked["__bin"] == offsets["__b"]))
    ranked = ranked.select(*OUTPUT[:5], (F.col("__base") + F.col("__before") + F.col("__nth") - 1).alias("spot"))
    table = np.array(sorted((base[p[0]] + p[1], p[3], p[4]) for p in plan), np.int64).T
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(*(np.ascontiguousarray(x) for x in table)), kinds)


def query(spark, directory):
    import public_tokenizers

    docs = spark.read.parquet(f"{directory}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
