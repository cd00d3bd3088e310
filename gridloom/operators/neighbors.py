"""Exact nearest neighbours by an index kept as tables.

Points are cut into blocks of bounded size that share their missing coordinates and lie around one pivot;
each block has the smallest box that holds it. Some thousand neighbouring blocks form a region, whose box holds
theirs. A query first looks at regions, then at the boxes of those in reach, which leaves blocks with a lower
bound of the distance. They are visited nearest first in growing numbers, and after every round only blocks
nearer than the k-th neighbour found so far remain. No neighbour is lost, whatever the boxes prune. The
driver holds one row per region, that is per some 20 million points. Coordinates may be
missing: the distance then uses the shared ones, scaled up to the full length. A search whose distances are few
(the caller says how many) is cheaper without the index, whose steps are jobs: every query visits every block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, type_of
from ..session import checkpointed
from .attach import attach

BLOCK_ROWS = 20_000
DISTANCES_AT_ONCE = 1 << 20  # between queries and points of a block
MAX_PIVOTS = 512
REGION_BLOCKS = 1024
CHUNK_QUERIES = 1000  # queries that visit a block together where all visit all
CELL = ["__pattern", "__pivot", "__inner"]
ALONE = "all"  # the block of a table that is one block
FIRST_VISITS, MORE_VISITS = 1, 4  # blocks a query visits in the first round, and the growth from round to round
BOUNDS_AT_ONCE = 1 << 20  # query and box coordinates compared in one step


def _matrix(series: pd.Series) -> np.ndarray:
    rows = series.to_numpy()
    if len(rows) and all(isinstance(v, np.ndarray) and v.dtype == float for v in rows):
        return np.stack(rows)  # no object per number
    return np.array([[np.nan if x is None else x for x in v] for v in series], dtype=float)


def _squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances over shared coordinates, scaled to all; infinite when nothing is shared."""
    here, there = ~np.isnan(queries), ~np.isnan(points)
    q, p = np.where(here, queries, 0.0), np.where(there, points, 0.0)
    total = (q * q) @ there.T + here @ (p * p).T - 2.0 * (q @ p.T)
    shared = here.astype(float) @ there.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.maximum(total, 0.0) * (queries.shape[1] / shared), np.inf)


def _exact(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The same distances from coordinate differences, free of cancellation."""
    gap = points - query
    shared = (~np.isnan(gap)).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.nansum(gap * gap, axis=1) * (len(query) / shared), np.inf)


def _pivots(points: DataFrame, rows: int, block_rows: int) -> np.ndarray:
    """A small repeatable sample of the points, bounded by ``MAX_PIVOTS``."""
    wanted = int(min(MAX_PIVOTS, max(1, rows // block_rows * 2)))
    share = min(1.0, 4.0 * wanted / max(rows, 1))
    chosen = points.where(F.rand(7) <= share).select("__vector").limit(wanted).collect()
    return _matrix(pd.Series([r[0] for r in chosen])) if chosen else np.zeros((1, 1))


def _blocks(points: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """Add ``__pattern`` of missing coordinates, nearest ``__pivot``, the nearest pivot ``__inner`` of that cell if it is
    crowded, and a ``__part``, so that the four name a block (``__block``)."""
    pivots = np.nan_to_num(_pivots(points, rows, block_rows))

    @F.pandas_udf("int")
    def nearest_pivot(vectors: pd.Series) -> pd.Series:
        return pd.Series(_squared(_matrix(vectors), pivots).argmin(axis=1).astype("int32"))

    pattern = F.concat_ws("", F.transform("__vector", lambda x: F.when(x.isNull() | F.isnan(x), "0").otherwise("1")))
    celled = points.withColumns({"__pattern": pattern, "__pivot": nearest_pivot("__vector")})
    inner = _inner_pivots(_counted(celled, CELL[:2]), block_rows)
    sized = _counted(inner, CELL)
    part = F.pmod(F.xxhash64("__point"), F.ceil(F.col("__rows") / block_rows)).cast("int")
    name = F.concat_ws("|", "__pattern", *[F.col(c).cast("string") for c in CELL[1:]], part.cast("string"))
    return checkpointed(sized.select("__point", "__payload", "__vector", *CELL, part.alias("__part"), name.alias("__block")))


def _counted(df: DataFrame, keys: list) -> DataFrame:
    """Add the rows of a row's group; groups may be crowded."""
    df = checkpointed(df)
    return attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), keys, "__rows")


def _inner_pivots(sized: DataFrame, block_rows: int) -> DataFrame:
    """Rows of cells with more than ``block_rows`` rows get the nearest of the cell's own pivots as ``__inner``, others 0."""
    plain = ["__point", "__payload", "__vector", *CELL[:2]]
    crowded = sized.where(F.col("__rows") > block_rows)
    chunks = F.ceil(F.col("__rows") / (16 * block_rows)).cast("int")
    wanted = F.least(F.lit(MAX_PIVOTS), 2 * F.ceil(F.col("__rows") / block_rows))
    seeds = crowded.where(F.pmod(F.xxhash64("__point", F.lit(11)), "__rows") < wanted).select(
        F.col("__pattern").alias("__p"), F.col("__pivot").alias("__c"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__k"), F.col("__vector").alias("__seed"))
    chunked = crowded.select(*plain, F.pmod(F.xxhash64("__point"), chunks).cast("int").alias("__chunk"))

    def nearest(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        inner = np.zeros(len(mine), "int32")
        if len(mine) and len(theirs):
            at = np.nan_to_num(_matrix(theirs["__seed"]))
            step = max(1, 4_000_000 // len(at))
            for start in range(0, len(mine), step):
                some = _matrix(mine["__vector"].iloc[start:start + step])
                inner[start:start + step] = _squared(some, at).argmin(axis=1)
        return mine[plain].assign(__inner=inner)

    group = [*CELL[:2], "__chunk"]
    shape = "__point long, __payload double, __vector array<double>, __pattern string, __pivot int, __inner int"
    split = chunked.groupBy(*group).cogroup(seeds.groupBy("__p", "__c", "__k")).applyInPandas(lambda a, b: nearest(a, b), shape)
    rest = sized.where(F.col("__rows") <= block_rows).select(*plain, F.lit(0).alias("__inner"))
    return rest.unionByName(split)


def _boxes(blocks: DataFrame, dims: int, region_blocks: int) -> DataFrame:
    """One row per block: its rows, the corners of its box, and its ``__region`` of neighbouring blocks."""
    present = [F.when(~F.isnan(F.col("__vector")[i]), F.col("__vector")[i]) for i in range(dims)]
    found = checkpointed(blocks.groupBy(*CELL, "__part", "__block").agg(
        F.count(F.lit(1)).alias("__rows"),
        F.array(*[F.min(v) for v in present]).alias("__low"), F.array(*[F.max(v) for v in present]).alias("__high")))
    regions = max(1, -(-found.count() // region_blocks))
    placed = found.repartitionByRange(regions, *CELL, "__part").withColumn("__region", F.spark_partition_id())
    return checkpointed(placed)


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances that no point of a box is nearer or farther than, per query and box whose points all have
    the coordinates of the box; infinite when none is shared."""
    shared = ~np.isnan(q)[:, None, :] & ~np.isnan(low)[None, :, :]
    under = np.nan_to_num(low[None] - q[:, None])
    over = np.nan_to_num(q[:, None] - high[None])
    near = np.where(shared, np.maximum(np.maximum(under, over), 0.0), 0.0)
    far = np.where(shared, np.maximum(np.abs(under), np.abs(over)), 0.0)
    count = shared.sum(2)
    scale = q.shape[1] / np.maximum(count, 1)
    nearest = np.where(count > 0, (near * near).sum(2) * scale, np.inf)
    return nearest, np.where(count > 0, (far * far).sum(2) * scale, np.inf)


def _radius(farthest: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Per query a squared distance within which at least k points of the boxes lie."""
    order = np.argsort(farthest, axis=1)
    enough = (np.cumsum(rows[order], axis=1) >= k)
    first = enough.argmax(1)
    at = np.arange(len(farthest))
    return np.where(enough.any(1), farthest[at, order[at, first]], np.inf)


def _within(nearest: np.ndarray, radius: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.isfinite(nearest) & (nearest <= radius[:, None] * (1 + 1e-9) + 1e-12)


def _regions(boxes: DataFrame, k: int, dims: int):
    """A function from query vectors to the regions that may hold one of their k nearest points."""
    found = boxes.groupBy("__region").agg(
        F.sum("__rows").alias("rows"), (F.min("__pattern") == F.max("__pattern")).alias("pure"),
        F.array(*[F.min(F.col("__low")[i]) for i in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("__high")[i]) for i in range(dims)]).alias("high")).orderBy("__region").collect()
    names = np.array([r["__region"] for r in found], dtype="int32")
    rows, pure = np.array([r["rows"] for r in found], float), np.array([r["pure"] for r in found], bool)
    low, high = _matrix(pd.Series([r["low"] for r in found])), _matrix(pd.Series([r["high"] for r in found]))

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series) -> pd.Series:
        out, q = [], _matrix(vectors)
        step = max(1, BOUNDS_AT_ONCE // max(1, low.size))
        for start in range(0, len(q), step):
            some = q[start:start + step]
            nearest, farthest = _bounds(some, low, high)
            # Points of a region with several patterns share unknown coordinates: a mean is at least the least term.
            shared = ~np.isnan(some)[:, None, :] & ~np.isnan(low)[None, :, :]
            gap = np.maximum(np.maximum(low[None] - some[:, None], some[:, None] - high[None]), 0.0)
            least = np.where(shared, np.nan_to_num(gap), np.inf).min(2) ** 2 * some.shape[1]
            nearest = np.where(pure[None, :], nearest, least)
            farthest = np.where(pure[None, :], farthest, np.inf)
            keep = _within(nearest, _radius(farthest, rows, k))
            out += [names[row] for row in keep]
        return pd.Series(out)

    return reachable


def _candidates(queries: DataFrame, boxes: DataFrame, dims: int, k: int, chunk_rows: int) -> DataFrame:
    """(__query, __block, __least): the blocks that may hold one of a query's k nearest points, with a lower bound
    of the squared distance."""
    asked = queries.select("__query", "__vector", F.explode(_regions(boxes, k, dims)("__vector")).alias("__region"))
    counts = asked.groupBy("__region").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("__chunks"))
    counts = F.broadcast(counts)  # one row per region, which the driver holds anyway
    asked = asked.join(counts, "__region").withColumn("__chunk", F.pmod(F.xxhash64("__query"), F.col("__chunks")).cast("int"))
    there = boxes.join(counts, "__region").withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))

    def bound(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        names = theirs["__block"].to_numpy()
        out_q, out_b, out_d = [], [], []
        if len(mine) and len(theirs):
            low, high, rows = _matrix(theirs["__low"]), _matrix(theirs["__high"]), theirs["__rows"].to_numpy(float)
            q, keys = _matrix(mine["__vector"]), mine["__query"].to_numpy()
            step = max(1, BOUNDS_AT_ONCE // max(1, low.size))
            for start in range(0, len(q), step):
                nearest, farthest = _bounds(q[start:start + step], low, high)
                i, j = np.nonzero(_within(nearest, _radius(farthest, rows, k)))
                out_q.append(keys[start + i])
                out_b.append(names[j])
                out_d.append(nearest[i, j])
        empty = [np.zeros(0)]
        return pd.DataFrame({"__query": np.concatenate(out_q or empty), "__block": np.concatenate(out_b or [np.zeros(0, object)]),
                             "__least": np.concatenate(out_d or empty)})

    group = ["__region", "__chunk"]
    return asked.select(*group, "__query", "__vector").groupBy(*group).cogroup(
        there.select(*group, "__block", "__rows", "__low", "__high").groupBy(*group)
    ).applyInPandas(lambda a, b: bound(a, b), "__query long, __block string, __least double")


def _visit_all(queries: DataFrame, asked: int, points: DataFrame, rows: int, k: int, block_rows: int) -> DataFrame:
    """As ``_visit``, for ``asked`` queries that all visit all blocks; points are dealt to blocks by hash."""
    blocks, chunks = -(-rows // block_rows), max(1, -(-asked // CHUNK_QUERIES))
    group = ["__block", "__chunk"]
    tasks = min(blocks * chunks, 4 * queries.sparkSession.sparkContext.defaultParallelism)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    mine = queries.withColumn("__chunk", F.pmod(F.xxhash64("__query"), F.lit(chunks)).cast("int")).withColumn("__block", every(blocks))
    theirs = points.withColumn("__block", F.pmod(F.xxhash64("__point"), F.lit(blocks)).cast("int")).withColumn("__chunk", every(chunks))
    # A number of partitions of its own: the rows are few bytes, the distances are the work.
    return mine.select(*group, "__query", "__vector").repartition(tasks, *group).groupBy(*group).cogroup(
        theirs.select(*group, "__point", "__payload", "__vector").repartition(tasks, *group).groupBy(*group)
    ).applyInPandas(lambda a, b: _best(a, b, k), "__query long, __point long, __d2 double, __payload double")


def _visit(visits: DataFrame, blocks: DataFrame, k: int, block_rows: int, alone: bool = False) -> DataFrame:
    """(__query, __point, __d2, __payload): the k nearest points of every visited block. ``visits`` holds (__query,
    __vector, __block)."""
    load = visits.groupBy("__block").agg(F.count(F.lit(1)).alias("__visits"))
    chunks = F.ceil(F.col("__visits") / block_rows)
    # A block may be visited by very many queries: attach spreads them. With one block the load is one row.
    known = visits.join(F.broadcast(load), "__block") if alone else attach(visits, load, ["__block"], "__visits")
    chunked = known.withColumn("__chunk", F.pmod(F.xxhash64("__query"), chunks).cast("int"))
    copies = blocks.join(load.select("__block", chunks.cast("int").alias("__chunks")), "__block").withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    group = ["__block", "__chunk"]
    return chunked.select(*group, "__query", "__vector").groupBy(*group).cogroup(
        copies.select(*group, "__point", "__payload", "__vector").groupBy(*group)
    ).applyInPandas(lambda a, b: _best(a, b, k), "__query long, __point long, __d2 double, __payload double")


def _best(mine: pd.DataFrame, theirs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of the points of one block for every query of one chunk."""
    if mine.empty or theirs.empty:
        return pd.DataFrame({"__query": [], "__point": [], "__d2": [], "__payload": []})
    theirs = theirs.sort_values("__point")
    p, ids = _matrix(theirs["__vector"]), theirs["__point"].to_numpy()
    extra = theirs["__payload"].to_numpy(dtype=float)
    q, keys = _matrix(mine["__vector"]), mine["__query"].to_numpy()
    rows, step = [], max(1, DISTANCES_AT_ONCE // len(p))
    for start in range(0, len(q), step):
        rough = _squared(q[start:start + step], p)
        kth = np.partition(rough, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1]
        slack = 1e-9 * (1.0 + np.nanmax(np.abs(p), initial=0.0) ** 2) * p.shape[1]
        for i, row in enumerate(rough):
            near = np.flatnonzero((row <= kth[i] + slack) & np.isfinite(row))
            exact = _exact(q[start + i], p[near])
            order = np.argsort(exact, kind="stable")[:k]
            chosen = near[order]
            rows.append((np.full(len(order), keys[start + i]), ids[chosen], exact[order], extra[chosen]))
    names = ("__query", "__point", "__d2", "__payload")
    return pd.DataFrame({n: np.concatenate([r[i] for r in rows]) for i, n in enumerate(names)})


def _nearest_first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("__query").orderBy("__d2", "__point")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def search_rounds(queries: DataFrame, blocks: DataFrame, boxes: DataFrame, dims: int, k: int, block_rows: int, visited: list | None = None) -> DataFrame:
    """The k nearest points of every query, block after block; ``visited`` is told the visits of each round."""
    waiting = checkpointed(_candidates(queries, boxes, dims, k, block_rows))
    best, allowed = None, FIRST_VISITS
    while True:
        order = Window.partitionBy("__query").orderBy("__least", "__block")
        ranked = waiting.withColumn("__rank", F.row_number().over(order))
        now = ranked.where(F.col("__rank") <= allowed).join(queries, "__query").select("__query", "__vector", "__block")
        if visited is not None:
            visited.append(now.count())
        found = _visit(now, blocks, k, block_rows)
        best = checkpointed(_nearest_first(found if best is None else best.unionByName(found), k))
        radius = best.groupBy("__query").agg(F.max("__d2").alias("__far"), F.count(F.lit(1)).alias("__found")).select(
            "__query", F.when(F.col("__found") >= k, F.col("__far")).alias("__far"))
        # An equal distance may still win by its key.
        open_ = F.col("__far").isNull() | (F.col("__least") <= F.col("__far") * (1 + 1e-9) + 1e-12)
        waiting = checkpointed(ranked.where(F.col("__rank") > allowed).drop("__rank").join(radius, "__query", "left").where(open_).drop("__far"))
        if waiting.isEmpty():
            return best
        allowed *= MORE_VISITS


def nearest_neighbors(queries: DataFrame, query_key: str, points: DataFrame, point_key: str, vector: str,
                      k: int = 5, block_rows: int = BLOCK_ROWS, payload: str | None = None,
                      region_blocks: int = REGION_BLOCKS, visited: list | None = None, all_pairs: int = 0) -> DataFrame:
    """(query key, ``neighbor``, ``distance``, ``position``): the k nearest points of every query.

    Keys are unique longs; equal distances are settled by the smaller point key. A numeric ``payload``
    column of the points comes along as ``payload``: joining it back later would meet points that are
    near to very many queries as hot keys. ``visited`` is filled with the number of (query, block) visits per round.
    Up to ``all_pairs`` coordinate differences between all queries and points there is no index.
    """
    vec = F.transform(col(vector), lambda x: x.cast("double")).alias("__vector")
    left = queries.select(col(query_key).cast("long").alias("__query"), vec)
    carried = col(payload).cast("double") if payload else F.lit(None).cast("double")
    right = points.select(col(point_key).cast("long").alias("__point"), carried.alias("__payload"), vec)
    first = right.first()
    if first is None:
        return _result(left.select("__query").limit(0).select("__query", *_no_neighbor()), query_key, k)
    rows = right.count()
    asked = left.count() if all_pairs else 0
    if all_pairs and asked * rows * max(1, len(first["__vector"])) <= all_pairs:
        return _result(_visit_all(left, asked, right, rows, k, block_rows), query_key, k)
    if rows <= block_rows:  # one block, visited by every query
        blocks = right.withColumn("__block", F.lit(ALONE))
        return _result(_visit(left.withColumn("__block", F.lit(ALONE)), blocks, k, block_rows, alone=True), query_key, k)
    left = checkpointed(left)
    blocks = _blocks(right, rows, block_rows)
    dims = len(first["__vector"])
    boxes = _boxes(blocks, dims, region_blocks)
    return _result(search_rounds(left, blocks, boxes, dims, k, block_rows, visited), query_key, k)


def _no_neighbor():
    return F.lit(None).cast("long").alias("__point"), F.lit(None).cast("double").alias("__d2"), F.lit(None).cast("double").alias("__payload")


def _result(local: DataFrame, query_key: str, k: int) -> DataFrame:
    order = Window.partitionBy("__query").orderBy("__d2", "__point")
    return (
        local.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
        .select(F.col("__query").alias(query_key), F.col("__point").alias("neighbor"),
                F.sqrt("__d2").alias("distance"), "position", F.col("__payload").alias("payload"))
    )


def knn_classify(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, prediction, share): majority of the k nearest numeric classes, the smaller one on a tie."""
    near = nearest_neighbors(test, key, train, key, vector, k, block_rows, payload=label)
    votes = near.groupBy(col(key), "payload").agg(F.count(F.lit(1)).alias("n"))
    winner = F.min_by("payload", F.struct(-F.col("n"), F.col("payload"))).cast(type_of(train, label))
    return votes.groupBy(col(key)).agg(winner.alias("prediction"), (F.max("n") / F.sum("n")).alias("share"))


def knn_regress(train: DataFrame, test: DataFrame, key: str, vector: str, target: str, k: int = 5,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, prediction): mean target of the k nearest."""
    near = nearest_neighbors(test, key, train, key, vector, k, block_rows, payload=target)
    return near.groupBy(col(key)).agg(F.avg("payload").alias("prediction"))


def standardize(df: DataFrame, vector: str, fit_on: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Centre and scale an array column by the mean and population deviation of ``fit_on``."""
    fit_on = df if fit_on is None else fit_on
    stats = (
        fit_on.select(F.posexplode(col(vector)).alias("i", "x")).groupBy("i")
        .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    )
    means = F.array(*[F.lit(r["m"]) for r in stats])
    scales = F.array(*[F.lit(r["s"] or 1.0) for r in stats])
    centred = F.zip_with(col(vector), means, lambda x, m: x - m)
    return df.withColumn(out or vector, F.zip_with(centred, scales, lambda x, s: x / s))
