"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Distinct vectors are nodes; a node travels as a code of 16-bit integers and its norm. First neighbours come from
leaves of random hyperplanes and from random blocks. Then, round by round, every node sends its code to
the nodes in its list (some that are new to the list and some older ones). Nodes that meet at a common
neighbour are neighbours of neighbours: they are compared, and pairs that beat the end of a list go into it.
The rounds end when few entries are new. A search keeps a beam of the best nodes found for a query,
sends the query to those not yet visited, compares it with their lists there, and ends when all
of the beam are visited. The best of the beam are compared by the original vectors in double precision.

Lists follow the angle, scores the inner product; the longest vectors start every beam, so they are
found from everywhere.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import scratch_path
from .common import shuffle_partitions, stored

LIST = 48  # neighbours a node keeps
SEND_NEW, SEND_OLD = 16, 16  # entries of a list visited in a round
OFFER = 8  # pairs a node takes along from one meeting
MEETING = 128  # nodes compared at once
TABLES, RANDOM_TABLES = 8, 2  # of leaves, and of random blocks
LEAF = 512
FIRST = 24  # neighbours taken from a leaf
ROUNDS, SETTLED = 8, 0.05  # at most so many rounds, fewer once this share of entries is new
BEAM = 256
LONGEST = 64  # vectors of largest norm that start every beam
VERIFIED = 60  # of the beam, by the original vectors
WORKER_ROWS = 1_000  # lists, or lists with their guests, that a Python worker holds
GUESTS = 256  # queries that visit a node's list together
CROWD = 2_000  # visitors of a node beyond which they meet in several groups
GRAPH = "node long, code binary, nbrs array<long>, sims array<float>, open array<boolean>, cand boolean"
GRAPH_TYPES = [("node", pa.int64()), ("code", pa.binary()), ("nbrs", pa.list_(pa.int64())),
               ("sims", pa.list_(pa.float32())), ("open", pa.list_(pa.bool_())), ("cand", pa.bool_())]


def encode(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: components as 16-bit integers of the row's own scale, and its norm as a float."""
    top = np.abs(x).max(axis=1, keepdims=True)
    whole = np.rint(x / top * 32767).astype("<i2")
    norm = np.minimum(top * np.sqrt(((x / top) ** 2).sum(1, keepdims=True)), np.finfo(np.float32).max).astype("<f4")
    return np.concatenate([whole.view(np.uint8), norm.view(np.uint8)], axis=1)


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) of rows of code bytes."""
    x = np.ascontiguousarray(code[:, :-4]).view("<i2").astype(np.float32)
    norm = np.ascontiguousarray(code[:, -4:]).view("<f4")[:, 0]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], norm


def code_bytes(column) -> np.ndarray:
    """Codes of one length as a matrix of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].reshape(len(column), -1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random number of a pair: equal similarities are ordered by it, so none is everyone's neighbour."""
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _list(ends: np.ndarray, values, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(at)


def _groups(batches, keys):
    """Arrow tables of whole groups of rows that come sorted by ``keys``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        differs = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            differs |= values != values[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def _edges(table: pa.Table, keys) -> np.ndarray:
    change = np.ones(table.num_rows + 1, bool)
    change[1:-1] = False
    for k in keys:
        values = table.column(k).to_numpy()
        change[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _offers(nodes: np.ndarray, code: np.ndarray, bar: np.ndarray, count: int):
    """Per node of one meeting its best others above its bar: (node, other, similarity)."""
    if len(nodes) < 2:
        return nodes[:0], nodes[:0], np.zeros(0, np.float32)
    x, _ = decode(code)
    sims = x @ x.T
    sims[nodes[:, None] == nodes[None, :]] = -2
    count = min(count, len(nodes) - 1)
    best = np.argpartition(-sims, count - 1, axis=1)[:, :count]
    value = np.take_along_axis(sims, best, 1)
    fine = (value > bar[:, None]) & (value > -2)
    return np.repeat(nodes, fine.sum(1)), nodes[best[fine]], value[fine]


def _candidates(found) -> pa.RecordBatch:
    """Offers as rows like those of the graph."""
    node, other, sim = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(node, kind="stable")
    node, other, sim = node[order], other[order], sim[order]
    ids, counts = np.unique(node, return_counts=True)
    ends = np.cumsum(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.binary()), _list(ends, other, pa.int64()),
         _list(ends, sim.astype(np.float32), pa.float32()), _list(ends, np.ones(len(other), bool), pa.bool_()),
         pa.array(np.ones(len(ids), bool))], [n for n, _ in GRAPH_TYPES])


def _meet(keys, size: int, count: int):
    """Rows (node, code, bar) sorted by meeting: what the nodes of a meeting offer each other."""
    def run(batches):
        for table in _groups(batches, keys):
            nodes, bar = table.column("node").to_numpy(), table.column("bar").to_numpy()
            codes = table.column("code").combine_chunks()
            edges, found, held = _edges(table, keys), [], 0
            for lo, hi in zip(edges, edges[1:]):
                for a in range(lo, hi, size):
                    b = min(hi, a + size)
                    found.append(_offers(nodes[a:b], code_bytes(codes.slice(a, b - a)), bar[a:b], count))
                    held += len(found[-1][0])
                if held > 1 << 16:
                    yield _candidates(found)
                    found, held = [], 0
            if held:
                yield _candidates(found)

    return run


def _send(fresh: int | None, old: int, round_: int, keep: int):
    """Graph rows as visits (at, node, code, bar): new entries first, then some old ones, and the node itself."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            nbrs, sizes = _flat(batch.column("nbrs"))
            sims, _ = _flat(batch.column("sims"))
            is_new, _ = _flat(batch.column("open"))
            row = np.repeat(np.arange(len(node)), sizes)
            take = _first(is_new, sizes, fresh)
            if old:
                draw = np.where(is_new, np.inf, _mix(node[row] + round_, nbrs).astype(np.float64))
                order = np.lexsort((draw, row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                take[order] |= (place < old) & ~is_new[order]
            bar = np.full(len(node), -2, np.float32)
            full = np.flatnonzero(sizes >= keep)
            bar[full] = sims[np.cumsum(sizes)[full] - 1]
            own = np.arange(len(node)) if old else np.arange(0)
            at = np.concatenate([nbrs[take], node[own]])
            who = np.concatenate([row[take], own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(node[who], pa.int64()), batch.column("code").take(pa.array(who)),
                 pa.array(bar[who])], ["at", "node", "code", "bar"])

    return run


def _first(flags: np.ndarray, sizes: np.ndarray, count: int | None) -> np.ndarray:
    """The first ``count`` true flags of every list."""
    if count is None:
        return flags.copy()
    before = np.cumsum(flags) - flags
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    base = np.zeros(len(sizes), before.dtype)
    base[some] = before[starts[some]]
    return flags & (before - np.repeat(base, sizes) < count)


def _merge(keep: int, sent: int | None):
    """Graph rows and candidates sorted by node: the best ``keep`` entries of every node. Visited entries are no longer open."""
    def run(batches):
        for table in _groups(batches, ["node"]):
            node, cand = table.column("node").to_numpy(), table.column("cand").to_numpy()
            nbrs, sizes = _flat(table.column("nbrs"))
            sims, _ = _flat(table.column("sims"))
            fresh, _ = _flat(table.column("open"))
            fresh = fresh & ~(_first(fresh, sizes, sent) & ~np.repeat(cand, sizes))
            owner = np.repeat(node, sizes)
            other = nbrs != owner
            owner, nbrs, sims, fresh = owner[other], nbrs[other], sims[other], fresh[other]
            order = np.lexsort((fresh, nbrs, owner))
            owner, nbrs, sims, fresh = owner[order], nbrs[order], sims[order], fresh[order]
            single = np.ones(len(owner), bool)
            single[1:] = (owner[1:] != owner[:-1]) | (nbrs[1:] != nbrs[:-1])
            owner, nbrs, sims, fresh = owner[single], nbrs[single], sims[single], fresh[single]
            order = np.lexsort((_mix(owner, nbrs), -sims, owner))
            owner, nbrs, sims, fresh = owner[order], nbrs[order], sims[order], fresh[order]
            base = np.flatnonzero(~cand)  # a node has one graph row
            begins = np.searchsorted(owner, node[base])
            place = np.arange(len(owner)) - begins[np.searchsorted(node[base], owner)] if len(owner) else owner
            best = place < keep
            ends = np.cumsum(np.minimum(np.searchsorted(owner, node[base], side="right") - begins, keep))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[base], pa.int64()), table.column("code").combine_chunks().take(pa.array(base)),
                 _list(ends, nbrs[best], pa.int64()), _list(ends, sims[best], pa.float32()),
                 _list(ends, fresh[best], pa.bool_()), pa.array(np.zeros(len(base), bool))], [n for n, _ in GRAPH_TYPES])

    return run


def _codes(tables: int, depth: int, seed: int):
    """Vectors as nodes with their code and the leaf of every table (bits of random hyperplanes)."""
    def run(batches):
        planes = {}
        for batch in batches:
            flat, sizes = _flat(batch.column("vector"))
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                x = flat.astype(np.float64)[(ends[mine] - size)[:, None] + np.arange(size)]
                code = encode(x)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).normal(size=(int(size), tables * depth))
                unit, _ = decode(code)
                bits = ((unit @ planes[size]) > 0).reshape(len(mine), tables, depth)
                leaf = (bits * (1 << np.arange(depth, dtype=np.int64))).sum(2)
                at = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(at), pa.array(np.full(len(mine), size), pa.int32()), pa.array(decode(code)[1]),
                     pa.array([c.tobytes() for c in code], pa.binary()),
                     _list(np.arange(1, len(mine) + 1) * tables, leaf.ravel(), pa.int64())],
                    ["node", "size", "norm", "code", "leaves"])

    return run


def split_crowds(df: DataFrame, keys: list, counts: DataFrame, limit: int) -> DataFrame:
    """Add ``group``: 0, or for keys with more than ``limit`` rows (by ``counts``: keys, n) one of as many as they need."""
    crowded = counts.where(F.col("n") > limit).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("n") / limit).alias("__groups"))
    on = [df[k] == crowded[f"__{k}"] for k in keys]
    group = F.coalesce(F.pmod(F.xxhash64("node"), "__groups"), F.lit(0)).cast("int")
    return df.join(crowded, on, "left").select(*df.columns, group.alias("group"))


class _Rounds:
    """A table that every round writes anew; the one before goes."""

    def __init__(self, spark, label: str):
        self.spark, self.label, self.path = spark, label, None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, scratch_path(self.spark, self.label)
        df.write.parquet(self.path)
        if before:
            jvm = self.spark._jvm
            place = jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            jvm.java.lang.System.gc()  # lets Spark drop the shuffles of the round before
        return self.spark.read.schema(df.schema).parquet(self.path)


@contextmanager
def _small_batches(spark, rows: int):
    """Lists are wide rows: fewer of them go to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sorted(df: DataFrame, keys: list) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def nodes_of(vectors: DataFrame, kept_ids: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, vector, ids; rows: vec_id, vector). A node is named by the smallest vec_id of its vector and
    knows its smallest ``kept_ids`` ones."""
    vector = col("embedding")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.where(col("vec_id").isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0))
    rows = usable.select(col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("__place", order).where(F.col("__place") <= kept_ids)
    nodes = few.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(nodes, "nodes"), rows


def neighbour_graph(nodes: DataFrame, size: int = LIST, rounds: int = ROUNDS, settled: float = SETTLED,
                    tables: int = TABLES, leaf: int = LEAF, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(graph: node, code, nbrs, sims, ...; codes: node, size, code) for nodes (node, vector), nearest entries first."""
    spark, count = nodes.sparkSession, nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, 2 * count / leaf)))))
    shape = "node long, size int, norm float, code binary, leaves array<long>"
    codes = stored(nodes.select("node", "vector").mapInArrow(_codes(tables, depth, seed), shape), "codes")
    blocks = max(1, -(-count // leaf))
    random = F.array(*[F.pmod(F.xxhash64("node", F.lit(t)), F.lit(blocks)) for t in range(RANDOM_TABLES)])
    placed = codes.select("node", "size", "code", F.posexplode(F.concat("leaves", random)).alias("table", "leaf"))
    keys = ["size", "table", "leaf"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    placed = split_crowds(placed, keys, counts, leaf).withColumn("bar", F.lit(-2).cast("float"))
    first = _sorted(placed, [*keys, "group"]).mapInArrow(_meet([*keys, "group"], 2 * leaf, FIRST), GRAPH)
    empty = "cast(array() as array<{}>)"
    start = codes.select("node", "code", F.expr(empty.format("long")).alias("nbrs"), F.expr(empty.format("float")).alias("sims"),
                         F.expr(empty.format("boolean")).alias("open"), F.lit(False).alias("cand"))
    table = _Rounds(spark, "graph")
    graph = table.put(_sorted(start.unionByName(first), ["node"]).mapInArrow(_merge(size, None), GRAPH))
    for i in range(rounds):
        visits = graph.mapInArrow(_send(SEND_NEW, SEND_OLD, i, size), "at long, node long, code binary, bar float")
        crowds = graph.select(F.explode("nbrs").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        visits = split_crowds(visits, ["at"], crowds, CROWD)
        found = _sorted(visits, ["at", "group"]).mapInArrow(_meet(["at", "group"], MEETING, OFFER), GRAPH)
        graph = table.put(_sorted(graph.unionByName(found), ["node"]).mapInArrow(_merge(size, SEND_NEW), GRAPH))
        new = graph.agg(F.sum(F.size(F.filter("open", lambda o: o)))).first()[0] or 0
        if new <= settled * size * count:
            break
    return graph, codes.drop("leaves")


def _begin(longest: list):
    """Query nodes with the scores of their lists and of the longest vectors: the first beams."""
    def run(batches):
        by_size: dict = {}
        for node, code in longest:
            by_size.setdefault(len(code), []).append((node, np.frombuffer(code, np.uint8)))
        for batch in batches:
            found = []
            for node, code in zip(batch.column("node").to_pylist(), batch.column("code").to_pylist()):
                others = [(n, c) for n, c in by_size.get(len(code), []) if n != node]
                if others:
                    x, norm = decode(np.stack([c for _, c in others]))
                    mine, _ = decode(np.frombuffer(code, np.uint8)[None, :])
                    found.append((np.full(len(others), node), np.array([n for n, _ in others]), x @ mine[0] * norm))
            if found:
                yield _candidates(found)

    return run


def _visit(batches):
    """Groups of queries beside the list of the node they visit: its entries that beat the end of a query's beam."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, sizes = _flat(batch.column("ids"))
        guests = batch.column("guests").combine_chunks() if isinstance(batch.column("guests"), pa.ChunkedArray) else batch.column("guests")
        counts = np.diff(guests.offsets.to_numpy())
        guests = guests.flatten()
        nodes, bar, codes = guests.field("node").to_numpy(), guests.field("bar").to_numpy(), guests.field("code")
        lists = batch.column("codes").flatten()
        ends, last = np.cumsum(sizes), np.cumsum(counts)
        found, held = [], 0
        for i in np.flatnonzero(sizes):
            lo, hi, first, stop = ends[i] - sizes[i], ends[i], last[i] - counts[i], last[i]
            x, norm = decode(code_bytes(lists.slice(lo, hi - lo)))
            mine, _ = decode(code_bytes(codes.slice(first, stop - first)))
            score = (mine @ x.T) * norm  # the query's own norm changes no order
            good = score > bar[first:stop, None]
            query, entry = np.nonzero(good)
            found.append((nodes[first:stop][query], ids[lo:hi][entry], score[good]))
            held += len(query)
            if held > 1 << 16:
                yield _candidates(found)
                found, held = [], 0
        if held:
            yield _candidates(found)


def _at_lists(visits: DataFrame, lists: DataFrame) -> DataFrame:
    """Visits, in groups of some ``GUESTS``, beside the list of the node they go to. Nodes that take 1/200 of all
    visits or more (so at most 200) have their lists broadcast, so that none is one task's work."""
    counts = stored(visits.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "visits")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where((F.col("n") > CROWD) & (F.col("n") * 200 >= total)).select("at").collect()]
    groups = split_crowds(visits, ["at"], counts, GUESTS).groupBy("at", "group").agg(
        F.collect_list(F.struct("node", "code", "bar")).alias("guests")).drop("group")
    if not hot:
        return groups.join(lists, "at")
    cold = groups.where(~F.col("at").isin(hot)).join(lists, "at")
    return cold.unionByName(groups.where(F.col("at").isin(hot)).join(F.broadcast(lists.where(F.col("at").isin(hot))), "at"))


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(node, nbrs, sims) for the query nodes: the ``beam`` nodes of largest inner product that a greedy walk finds."""
    spark = graph.sparkSession
    listed = graph.select(F.col("node").alias("owner"), F.posexplode("nbrs").alias("place", "at"))
    with_codes = listed.join(codes.select(F.col("node").alias("at"), F.col("code")), "at")
    # Bucketed by node: no later round moves the lists again.
    lists = with_codes.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("place", "at", "code"))).alias("l")).select(
        F.col("owner").alias("at"), F.col("l.at").alias("ids"), F.col("l.code").alias("codes"))
    path = scratch_path(spark, "lists")
    name = "gridloom_lists_" + path[-32:]
    parts = shuffle_partitions(graph)
    lists.repartition(parts, "at").write.bucketBy(parts, "at").sortBy("at").option("path", path).saveAsTable(name)
    lists = spark.table(name)
    longest = [tuple(r) for r in codes.orderBy(F.desc("norm"), "node").select("node", "code").limit(LONGEST).collect()]
    mine = graph.join(queries.select("node").distinct(), "node", "left_semi")
    own = mine.select("node", "code", F.expr("cast(array() as array<long>)").alias("nbrs"),
                      F.expr("cast(array() as array<float>)").alias("sims"),
                      F.expr("cast(array() as array<boolean>)").alias("open"), F.lit(False).alias("cand"))
    starts = own.mapInArrow(_begin([(n, bytes(c)) for n, c in longest]), GRAPH)
    here = own.select(F.col("node").alias("at"), F.array(F.struct(
        "node", "code", F.lit(float("-inf")).cast("float").alias("bar"))).alias("guests"))
    near = here.join(lists, "at").mapInArrow(_visit, GRAPH)
    table = _Rounds(spark, "beams")
    beams = table.put(_sorted(own.unionByName(starts).unionByName(near), ["node"]).mapInArrow(_merge(beam, None), GRAPH))
    while not beams.where(F.exists("open", lambda o: o)).isEmpty():
        # An entry enters a beam once as open, so the walk ends.
        visits = beams.mapInArrow(_send(None, 0, 0, beam), "at long, node long, code binary, bar float")
        found = _at_lists(visits, lists).mapInArrow(_visit, GRAPH)
        beams = table.put(_sorted(beams.unionByName(found), ["node"]).mapInArrow(_merge(beam, None), GRAPH))
    spark.sql(f"drop table {name}")
    return beams.select("node", "nbrs", "sims")


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM, verified: int = VERIFIED,
                    size: int = LIST, rounds: int = ROUNDS) -> DataFrame:
    """The ``k`` vectors of largest inner product found for every vec_id divisible by ``every``: query_id, rank, vec_id, score.

    Input: vec_id, embedding; other columns are ignored. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do rows without vec_id; vectors of different lengths do not meet. A
    vec_id names one vector: of rows that repeat it the smallest vector counts. Equal vectors are one node; as
    ties go to smaller vec_ids, its smallest k + 1 ones are all that any answer can hold. Scores are sums of
    products of the original components in double precision. A query with fewer candidates gets all that are
    found. An empty table gives no rows. Wider beams and longer lists find more of the true neighbours.
    """
    nodes, rows = nodes_of(vectors, k + 1)
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = stored(asked.join(nodes.select("vector", "node"), "vector").select(F.col("vec_id").alias("query_id"), "node"), "queries")
    with _small_batches(vectors.sparkSession, WORKER_ROWS):
        graph, codes = neighbour_graph(nodes, size, rounds)
        found = search(graph, codes, queries, beam)
    pairs = found.select(F.col("node").alias("query"), F.explode(F.slice("nbrs", 1, verified)).alias("node"))
    own = found.select(F.col("node").alias("query"), "node")
    exact = nodes.select("node", F.transform("vector", lambda v: v.cast("double")).alias("vector"), "ids")
    there = pairs.unionByName(own).join(exact, "node").select("query", "ids", F.col("vector").alias("other"))
    both = there.join(exact.select(F.col("node").alias("query"), "vector"), "query")
    score = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    answers = both.select("query", score.alias("score"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = answers.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    few = few.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    each = queries.join(few, queries["node"] == few["query"]).select(
        "query_id", F.filter("found", lambda f: f["vec_id"] != F.col("query_id")).alias("found"))
    return each.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def query(spark, directory):
    return nearest_vectors(spark.read.parquet(f"{directory}/embeddings.parquet"))
