"""Near duplicates among embeddings by spherical-cap filters.

A filter is a direction; a vector falls into it if its cosine with the direction exceeds a threshold. The
directions are structured random product codes: after a random rotation a vector is cut into blocks, each
with a small code of random unit words, and every choice of one word per block is a direction. The
directions a vector exceeds are found by decoding: partial sums are extended block by block and dropped
when the best rest cannot lift them over the threshold. Several independent codes are used. Vectors that
share a filter (and a label) are compared exactly; a pair is counted in its first common filter alone.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .common import stored
from .graph import components, local_roots

TABLES = 12  # independent codes
BLOCKS = 2
WORDS = 64  # per block: WORDS ** BLOCKS directions in a code
EXPECTED = 4.0  # directions of one code that a random vector exceeds on average
LEAST = 2  # a vector that exceeds fewer takes its best ones
BLOCK_ROWS = 1_500  # a larger bucket is split into blocks that are compared two by two
SMALL = 48  # buckets up to here are compared together, pair by pair
PAIRS_AT_ONCE = 100_000


def product_codes(size: int, tables: int, blocks: int, words: int, seed: int) -> list:
    """Per table: a rotation and per block its coordinates and words."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        turn, _ = np.linalg.qr(rng.normal(size=(size, size)))
        code = []
        for part in np.array_split(np.arange(size), min(blocks, size)):
            spread = rng.normal(size=(words, len(part)))
            code.append((part, spread / np.linalg.norm(spread, axis=1, keepdims=True)))
        out.append((turn, code))
    return out


def decode(x: np.ndarray, code: list, least_sum: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction whose sum exceeds ``least_sum``, or the row's best ``least`` words."""
    scores = [x[:, part] @ words.T for part, words in code]
    rest = np.zeros((len(scores) + 1, len(x)))
    for j in range(len(scores) - 1, -1, -1):
        rest[j] = rest[j + 1] + scores[j].max(1)
    # The bar of a row with few directions: its best sum less what replacing the last word by the next costs.
    last = np.sort(scores[-1], axis=1)
    bar = np.minimum(least_sum, rest[0] - (last[:, -1] - last[:, -min(least, last.shape[1])])) - 1e-12
    rows, total, ids = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
    for j, score in enumerate(scores):
        sums = total[:, None] + score[rows]
        i, k = np.nonzero(sums >= (bar - rest[j + 1])[rows][:, None])
        total, ids, rows = sums[i, k], ids[i] * score.shape[1] + k, rows[i]
    return rows, ids


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64; shorter lists end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) == 0 or sizes.min() == sizes.max():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max()))
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def _assign(tables, blocks, words, expected, least, seed):
    def run(batches):
        codes = {}
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = _vectors(part.column("vector"))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if size not in codes:
                    codes[size] = product_codes(int(size), tables, blocks, words, seed)
                count = words ** len(codes[size][0][1])
                cut = NormalDist().inv_cdf(1 - min(0.5, expected / count))
                rows, filters = [], []
                for t, (turn, code) in enumerate(codes[size]):
                    # A random unit vector's sum has variance blocks / size.
                    r, f = decode(x @ turn, code, cut * np.sqrt(len(code) / size), least)
                    rows.append(r)
                    filters.append(f + t * count)
                rows, filters = np.concatenate(rows), np.concatenate(filters)
                order = np.lexsort((filters, rows))
                ends = np.cumsum(np.bincount(rows, minlength=len(x)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(filters[order], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("vector"), lists],
                    ["vec_id", "label", "vector", "filters"])

    return run


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets - offsets[0]


def _earlier_common(a: np.ndarray, b: np.ndarray, own: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For pairs of rows and their filter: do both rows hold a smaller filter?"""
    base = int(flat.max()) + 1 if len(flat) else 1
    keys = np.repeat(np.arange(len(at) - 1), np.diff(at)) * base + flat  # rises, as lists are sorted
    found = np.zeros(len(a), bool)
    width = np.diff(at)[a]
    for j in range(int(width.max()) if len(width) else 0):
        open_ = np.flatnonzero((j < width) & ~found)
        value = flat[at[a[open_]] + j]
        keep = value < own[open_]
        open_, value = open_[keep], value[keep]
        if not len(open_):
            break
        wanted = b[open_] * base + value
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found[open_] = keys[spot] == wanted
    return found


def _linked_pairs(x, vec, own, flat, at, groups, side, least_cosine):
    """Pairs of rows linked and first met in their bucket; ``groups`` are (begin, end) runs of rows."""
    out_a, out_b = [], []

    def keep(a, b):
        a, b = a[vec[a] != vec[b]], b[vec[a] != vec[b]]
        fresh = ~_earlier_common(a, b, own[a], flat, at)
        out_a.append(a[fresh])
        out_b.append(b[fresh])

    sizes = groups[:, 1] - groups[:, 0]
    small = groups[(sizes <= SMALL) & (sizes > 1)]
    held_a, held_b, held = [], [], 0

    def flush():
        nonlocal held_a, held_b, held
        if held:
            a, b = np.concatenate(held_a), np.concatenate(held_b)
            near = np.einsum("ij,ij->i", x[a], x[b]) >= least_cosine
            keep(a[near], b[near])
        held_a, held_b, held = [], [], 0

    for size in np.unique(small[:, 1] - small[:, 0]):
        begins = small[small[:, 1] - small[:, 0] == size, 0]
        i, j = np.triu_indices(size, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for first in range(0, len(begins), step):
            some = begins[first:first + step, None]
            a, b = (some + i).ravel(), (some + j).ravel()
            cross = (side[a] != side[b]) | (side[a] < 0)
            held_a.append(a[cross])
            held_b.append(b[cross])
            held += int(cross.sum())
            if held >= PAIRS_AT_ONCE:
                flush()
    flush()
    for begin, end in groups[sizes > SMALL]:
        rows = np.arange(begin, end)
        left = rows if side[begin] < 0 else rows[side[rows] == 0]
        right = rows if side[begin] < 0 else rows[side[rows] == 1]
        for first in range(0, len(left), 256):
            some = left[first:first + 256]
            i, j = np.nonzero(x[some] @ x[right].T >= least_cosine)
            a, b = some[i], right[j]
            if side[begin] < 0:
                a, b = a[a < b], b[a < b]
            keep(a, b)
    return np.concatenate([np.zeros(0, np.int64), *out_a]), np.concatenate([np.zeros(0, np.int64), *out_b])


GROUP = ["label", "size", "filter", "p", "q"]


def _compare(least_cosine: float):
    def links(table: pa.Table):
        table = table.combine_chunks()
        column = {c: table.column(c).combine_chunks() if table.num_rows else table.column(c) for c in table.column_names}
        number = {c: column[c].to_numpy() for c in (*GROUP, "side", "vec_id")}
        x = _vectors(column["vector"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        change = np.zeros(len(x), bool)
        change[0] = True
        for c in GROUP:
            change[1:] |= number[c][1:] != number[c][:-1]
        begins = np.flatnonzero(change)
        groups = np.stack([begins, np.append(begins[1:], len(x))], axis=1)
        flat, at = _ragged(column["earlier"])
        a, b = _linked_pairs(x, number["vec_id"], number["filter"], flat, at, groups, number["side"], least_cosine)
        a, b = number["vec_id"][a], number["vec_id"][b]
        ids, counts = np.unique(np.concatenate([a, b]), return_counts=True)
        node, root = local_roots(a, b) if len(a) else (a, b)
        zero = np.zeros(len(node), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, node])), pa.array(np.concatenate([counts, zero])),
             pa.array(np.concatenate([ids, root]))], ["vec_id", "links", "root"])

    def run(batches):
        # Rows arrive sorted by group; the last group of a batch may go on in the next.
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            differs = np.zeros(table.num_rows, bool)
            for c in GROUP:
                values = table.column(c).to_numpy()
                differs |= values != values[-1]
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield links(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield links(rest)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct rows (vec_id, label, vector, size) that may link: no null, no non-finite part, not zero."""
    vector = col("embedding")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists(vector, lambda v: v != 0)
    keep = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite & some
    return vectors.where(keep).select(
        col("vec_id").cast("long").alias("vec_id"), col("label").cast("long").alias("label"), vector.alias("vector"),
        F.size(vector).alias("size")).dropDuplicates()


def near_vectors(
    vectors: DataFrame, least_cosine: float = 0.93, tables: int = TABLES, blocks: int = BLOCKS, words: int = WORDS,
    expected: float = EXPECTED, least: int = LEAST, seed: int = 23,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Input: vec_id, label, embedding (array of float or double); other columns are ignored. Vectors link if
    their labels are equal and not null and their cosine in double precision is at least
    ``least_cosine``. A vector that is null, zero, or holds a null or non-finite part links with nothing, nor
    does one with another number of parts. vec_id is a vector's name: rows that repeat it do not link with
    each other and get the same result; a null vec_id has no links and no component. An empty table
    gives no rows. More tables or expected directions find more of the pairs near the threshold.
    """
    shape = "vec_id long, label long, vector array<double>, filters array<int>"
    rows = usable(vectors).withColumn("vector", F.col("vector").cast("array<double>")).drop("size")
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"
    found = rows.mapInArrow(_assign(tables, blocks, words, expected, least, seed), shape)
    if narrow:  # floats are exact as floats
        found = found.withColumn("vector", F.col("vector").cast("array<float>"))
    found = stored(found.withColumn("size", F.size("vector")), "filters")
    each = found.select("label", "size", F.explode("filters").alias("filter"))
    counts = each.groupBy("label", "size", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(counts.where(F.col("n") > BLOCK_ROWS).select(
        F.col("label").alias("__l"), F.col("size").alias("__s"), F.col("filter").alias("__f"),
        F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("__blocks")), "crowded")
    placed = found.select(
        "vec_id", "label", "size", "vector", F.explode("filters").alias("filter"),
        F.col("filters").alias("earlier"))
    placed = placed.withColumn("earlier", F.filter("earlier", lambda f: f < F.col("filter")))
    # Crowded buckets: at most (rows x directions) / BLOCK_ROWS of them, a few bytes each.
    same = (placed["label"] == crowded["__l"]) & (placed["size"] == crowded["__s"]) & (placed["filter"] == crowded["__f"])
    placed = placed.join(crowded, same, "left")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("__blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("__blocks") - 1),
        lambda j: F.struct(
            F.least(j, mine).alias("p"), F.greatest(j, mine).alias("q"),
            F.when(j == mine, -1).when(mine < j, 0).otherwise(1).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(-1).alias("side")))
    placed = placed.withColumn("__part", F.explode(F.when(F.col("__blocks").isNull(), alone).otherwise(pairs)))
    placed = placed.select("vec_id", *GROUP[:3], "__part.*", "vector", "earlier")
    together = placed.repartition(*GROUP).sortWithinPartitions(*GROUP)
    partial = stored(together.mapInArrow(_compare(least_cosine), "vec_id long, links long, root long"), "links")
    links = partial.groupBy("vec_id").agg(F.sum("links").alias("__links"))
    joined = components(partial.where("links = 0").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    named = links.join(joined, F.col("vec_id") == F.col("node"), "left").select(
        F.col("vec_id").alias("__id"), "__links", F.col("component").alias("__component"))
    out = vectors.select(col("vec_id").cast("long").alias("vec_id"))
    component = F.coalesce(F.col("__component"), F.col("vec_id"))
    return out.join(named, F.col("vec_id") == F.col("__id"), "left").select(
        "vec_id", F.coalesce("__links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, directory):
    return near_vectors(spark.read.parquet(f"{directory}/embeddings.parquet"))


SQL = """
with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as materialized (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) as (
    select a, b from pairs union select r.vec_id, p.b from reach r join pairs p on r.other = p.a
), links as (select a as vec_id, count(*) as n from pairs group by a),
least as (select vec_id, min(other) as low from reach group by vec_id)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id,
       e.vec_id <= coalesce(low, e.vec_id) as kept
from embeddings e left join links using (vec_id) left join least using (vec_id)"""
