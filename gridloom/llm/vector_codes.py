"""Compression of vectors to part codes, with nearest entries found on a trie of distinct parts.

Components become integers, vectors are cut into four parts, and each part is named by the nearest of 256
codebook entries, which four rounds of means improve. Equal parts are counted once for all rounds. A task
sorts its distinct parts into a trie by dimension: a node holds the distances of all entries over the
dimensions up to it, so parts that begin alike share them; the walk goes depth first, an unbranched tail is
one edge, and a leaf takes its nearest entry and adds its weighted part to that entry's sum. All arithmetic
is on whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.attach import attach
from .common import shuffle_partitions, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAVES = 2048  # a subtree of at most so many parts is finished level by level, its distances in one matrix
LARGEST = 1 << 26  # fixed-point components are held within this
EXACT = 1 << 53  # whole numbers below are exact in a double


def _unbranched(parts: np.ndarray) -> np.ndarray:
    """Per part of a sorted table of distinct ones, the first dimension in which it differs from the one before it."""
    if len(parts) < 2:
        return np.zeros(len(parts), np.int64)
    return np.concatenate([[0], (parts[1:] != parts[:-1]).argmax(1)])


def _finish(parts, lcp, lo, hi, depth, shared, book):
    """Distances of the parts lo to hi to all entries; they share ``shared`` over the first ``depth`` dimensions."""
    rows = hi - lo
    dims = parts.shape[1]
    node = np.zeros(rows, np.int64)  # the row's node at the depth reached
    held = shared[None, :]
    while depth < dims and len(held) < rows:
        begins = lcp[lo:hi] <= depth
        begins[0] = True
        first = np.flatnonzero(begins)
        held = held[node[first]] + (parts[lo + first, depth][:, None] - book[None, :, depth]) ** 2
        node = np.cumsum(begins) - 1
        depth += 1
    held = held[node]
    if depth < dims:  # every part is alone on its way from here
        x, c = parts[lo:hi, depth:], book[:, depth:]
        held = held + ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :])
    return held


def nearest_entries(parts: np.ndarray, book: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``parts``, distinct and sorted lexicographically; ties to lower entries."""
    count, dims = parts.shape
    entry, error = np.zeros(count, np.int64), np.zeros(count, np.int64)
    if not count:
        return entry, error
    span = int(np.abs(parts).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.float64 if span * span * max(1, dims) < EXACT else np.int64
    parts, book = parts.astype(kind), book.astype(kind)
    lcp = _unbranched(parts)
    stack = [(0, count, 0, np.zeros(len(book), kind))]
    while stack:
        lo, hi, depth, shared = stack.pop()
        if hi - lo > leaves:
            while depth < dims and parts[lo, depth] == parts[hi - 1, depth]:
                shared = shared + (parts[lo, depth] - book[:, depth]) ** 2
                depth += 1
            edges = np.concatenate([[lo], lo + 1 + np.flatnonzero(lcp[lo + 1:hi] == depth), [hi]])
            below, first = [], 0
            while first < len(edges) - 1:  # neighbouring small children are finished together
                last = int(np.searchsorted(edges, edges[first] + leaves, side="right")) - 1
                last = max(first + 1, last)
                below.append((int(edges[first]), int(edges[last]), depth, shared))
                first = last
            stack += below[::-1]
            continue
        held = _finish(parts, lcp, lo, hi, depth, shared, book)
        entry[lo:hi] = held.argmin(1)
        error[lo:hi] = held[np.arange(hi - lo), entry[lo:hi]].astype(np.int64)
    return entry, error


def _sorted_distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the place of every row among them."""
    if parts.shape[1] == 0:
        return parts[:1], np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    begins = np.ones(len(parts), bool)
    begins[1:] = (ordered[1:] != ordered[:-1]).any(1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(begins) - 1
    return ordered[begins], place


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows, -1)


def _sums(books: list[np.ndarray]):
    def run(batches):
        total = [np.zeros(b.shape, np.int64) for b in books]
        used = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            position, weight = batch.column("position").to_numpy(), batch.column("n").to_numpy()
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                parts, place = _sorted_distinct(_matrix(batch.column("part").take(pa.array(mine)), len(mine)))
                n = np.zeros(len(parts), np.int64)
                np.add.at(n, place, weight[mine])
                entry, _ = nearest_entries(parts, books[p])
                np.add.at(total[p], entry, parts * n[:, None])
                np.add.at(used[p], entry, n)
        rows = [(p, int(e), int(used[p][e]), total[p][e]) for p in range(len(books)) for e in np.flatnonzero(used[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            ["position", "entry", "n", "total"])

    return run


def _encode(books: list[np.ndarray], cuts: list[int]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), batch.num_rows)
            codes, errors = np.zeros((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
            for p, book in enumerate(books):
                parts, place = _sorted_distinct(vectors[:, cuts[p]:cuts[p + 1]])
                entry, error = nearest_entries(parts, book)
                codes[:, p] = entry[place]
                errors += error[place]
            code = ["".join(f"{e:02x}" for e in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(errors)],
                ["vec_id", "label", "code", "error"])

    return run


def fixed_point(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, label, vector of integers) whose vector is not null or empty and has only finite components."""
    vector = col("embedding")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def whole(v):
        value = F.floor(v.cast("double") * scale)
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), value)).cast("int")

    kept = vectors.where(vector.isNotNull() & (F.size(vector) > 0) & finite)
    return kept.select(col("vec_id").cast("long").alias("vec_id"), col("label").alias("label"),
                       F.transform(vector, whole).alias("vector"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Input: vec_id, label, embedding; other columns are ignored. Vectors that are null, empty, or hold a null
    or non-finite component are left out, and so are those whose length is not that of the row with the
    smallest vec_id (null last, then the smaller vector). Repeated rows are returned each and weigh each;
    null labels are one label. Components beyond 65,536 in size count as that, so that sums stay whole
    numbers. If the length is no multiple of ``parts``, part i begins at floor(i * length / parts). Fewer than
    ``entries`` rows make a smaller codebook. An empty table gives no rows.

    The driver holds the codebooks (parts x entries rows), nothing that grows with the vectors.
    """
    spark = vectors.sparkSession
    rows = fixed_point(vectors, scale)
    ordered = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    first = ordered.select(F.size("vector")).first()
    size = first[0] if first else 1
    rows, ordered = (df.where(F.size("vector") == size) for df in (rows, ordered))
    cuts = [i * size // parts for i in range(parts + 1)]
    seeds = np.array([r[0] for r in ordered.select("vector").limit(entries).collect()], np.int64).reshape(-1, size)
    books = [seeds[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    each = F.posexplode(F.array(*[F.slice("vector", a + 1, b - a) for a, b in zip(cuts, cuts[1:])])).alias("position", "part")
    distinct = rows.select(each).groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    distinct = stored(
        distinct.repartitionByRange(shuffle_partitions(rows), "position", "part").sortWithinPartitions("position", "part"),
        "parts")
    for _ in range(rounds if len(seeds) else 0):
        sums = distinct.mapInArrow(_sums(books), "position int, entry int, n long, total array<long>")
        summed = sums.select("position", "entry", "n", F.posexplode("total").alias("dim", "total")).groupBy(
            "position", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for position, entry, dim, n, total in summed.collect():  # parts x entries x dimensions of a part
            books[position][entry, dim] = total // n
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    label = dict(rows.dtypes)["label"]
    coded = stored(rows.mapInArrow(_encode(books, cuts), f"vec_id long, label {label}, code string, error long"), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    found = attach(coded, by_label, ["label"], "rows")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, directory):
    return compress(spark.read.parquet(f"{directory}/embeddings.parquet"))


def _sql() -> str:
    """The rounds written out one after the other."""
    apart = "(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::bigint"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
near{i} as materialized (select vec_id, pos, arg_min(entry, (d, entry)) as entry, min(d) as d, any_value(x) as x
  from (select p.vec_id, p.pos, p.x, c.entry, {apart} as d from p join book{i} c using (pos)) group by vec_id, pos)""")
        if i < ROUNDS:
            steps.append(f"""
book{i + 1} as materialized (select pos, entry, coalesce(m.x, b.x) as x from book{i} b left join (
  select pos, entry, list(v order by j) as x from (
    select pos, entry, j, floor(sum(v) / count(*)) as v
    from (select pos, entry, unnest(x) as v, generate_subscripts(x, 1) as j from near{i}) group by pos, entry, j)
  group by pos, entry) m using (pos, entry))""")
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
p as materialized (select vec_id, pos, v[pos * (len(v) // 4) + 1 : (pos + 1) * (len(v) // 4)] as x from k, range(4) t(pos)),
book0 as materialized (select pos, row_number() over (partition by pos order by vec_id) - 1 as entry, x from p
  qualify row_number() over (partition by pos order by vec_id) <= 256),{','.join(steps)},
coded as (select vec_id, string_agg(printf('%02x', entry), '' order by pos) as code, sum(d)::bigint as error
  from near{ROUNDS} group by vec_id),
spelled as (select sha256(string_agg(v::bigint::varchar, ',' order by pos, entry, j)) as codebooks_sha256
  from (select pos, entry, unnest(x) as v, generate_subscripts(x, 1) as j from book{ROUNDS}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join k using (vec_id), spelled"""


SQL = _sql()
