"""The block join against brute force, with few and many blocks and missing coordinates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import neighbors
from gridloom.operators.clean import impute_neighbors
from gridloom.operators.neighbors import knn_classify, knn_regress, nearest_neighbors


def brute(queries, points, k):
    out = {}
    for qk, q in queries:
        near = []
        for pk, p in points:
            both = [(a, b) for a, b in zip(q, p) if a is not None and b is not None]
            if both:
                near.append((sum((a - b) ** 2 for a, b in both) * len(q) / len(both), pk))
        out[qk] = [pk for _, pk in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [1000, 40, 7])
@pytest.mark.parametrize("holes", [False, True])
def test_nearest_neighbors_are_exact(spark, block_rows, holes):
    rng = np.random.default_rng(3)
    # A third of the points coincide almost, as a hot cell would.
    data = np.vstack([rng.normal(size=(200, 3)), rng.normal(scale=0.01, size=(100, 3))])
    vectors = [[None if holes and rng.random() < 0.2 else round(float(x), 6) for x in row] for row in data]
    points = list(enumerate(vectors))
    queries = [(1000 + i, [round(float(x), 6) for x in rng.normal(size=3)]) for i in range(40)]
    if holes:
        queries = [(k, [None if rng.random() < 0.2 else x for x in v]) for k, v in queries]
    schema = "key long, v array<double>"
    found = nearest_neighbors(
        spark.createDataFrame(queries, schema), "key", spark.createDataFrame(points, schema), "key", "v", 5, block_rows
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["key"], r["position"])):
        got.setdefault(r["key"], []).append(r["neighbor"])
    assert got == {k: v for k, v in brute(queries, points, 5).items() if v}


def test_large_tables_visit_few_blocks(spark, monkeypatch):
    points = spark.range(200_000).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v")).cache()
    queries = points.where("id % 500 = 7").select((F.col("id") + 1_000_000).alias("id"), "v")
    monkeypatch.setattr(neighbors, "MAX_PIVOTS", 30)  # so that cells are split by pivots of their own
    visited = []
    found = nearest_neighbors(queries, "id", points, "id", "v", 5, 1000, region_blocks=16, visited=visited).toPandas()
    held = points.toPandas().sort_values("id")
    x = np.stack(held["v"].to_numpy())
    for key, rows in found.groupby("id"):
        distance = ((x - x[key - 1_000_000]) ** 2).sum(1)
        assert rows.sort_values("position")["neighbor"].tolist() == np.lexsort((np.arange(len(x)), distance))[:5].tolist()
    assert found["id"].nunique() == 400
    blocks = 200_000 // 1000
    assert len(visited) >= 2 and visited[0] == 400 and sum(visited) < 0.1 * 400 * blocks
    points.unpersist()


def test_many_patterns_of_missing_coordinates(spark):
    """More patterns than rows in a block, in regions that mix them."""
    rng = np.random.default_rng(8)
    rows = [(i, [None if rng.random() < 0.5 else round(float(x), 6) for x in rng.normal(size=9)]) for i in range(400)]
    asked = [(1000 + i, v) for i, (_, v) in enumerate(rows[:50])]
    schema = "key long, v array<double>"
    found = nearest_neighbors(
        spark.createDataFrame(asked, schema), "key", spark.createDataFrame(rows, schema), "key", "v", 3, 50, region_blocks=20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["key"], r["position"])):
        got.setdefault(r["key"], []).append(r["neighbor"])
    assert got == {k: v for k, v in brute(asked, rows, 3).items() if v}


def test_vectors_of_one_hash_keep_their_own_answers(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from gridloom.operators.models import NearestNeighbors

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    df = spark.range(40).select(F.col("id").cast("double").alias("label"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    found = NearestNeighbors(k=1).fit(df).transform(df)
    assert found.where("prediction <> label").count() == 0 and found.count() == 40


def test_few_distances_need_few_jobs(spark):
    """More points than a block: the same answers as by the index, equal points and ties included, from a few jobs."""
    from pyspark.ml.functions import array_to_vector

    from gridloom.operators.models import NearestNeighbors

    at = F.array((F.col("id") % 40).cast("double"), (F.col("id") % 7).cast("double"))
    df = spark.range(1200).select(F.col("id").cast("double").alias("label"), array_to_vector(at).alias("features")).coalesce(1)
    model = NearestNeighbors(k=5, blockRows=50).fit(df)
    spark.sparkContext.setJobGroup("few-distances", "")
    found = {tuple(r["features"]): r["prediction"] for r in model.transform(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-distances"))
    spark.sparkContext.setJobGroup("other", "")
    rows = [(i, [float(i % 40), float(i % 7)]) for i in range(1200)]
    asked = [(n, list(v)) for n, v in enumerate(found)]
    want = brute(asked, rows, 5)
    assert {v: sum(want[n]) / 5 for n, v in enumerate(found)} == pytest.approx(found)
    assert jobs <= 30


def test_all_pairs_equal_the_index(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [None if rng.random() < 0.2 else float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)]
    asked = [(1000 + i, v) for i, (_, v) in enumerate(rows[:60])]
    points, queries = (spark.createDataFrame(r, "key long, v array<double>") for r in (rows, asked))
    index, pairs = (sorted(map(tuple, nearest_neighbors(queries, "key", points, "key", "v", 4, 30, all_pairs=n).collect()), key=repr)
                    for n in (0, 10**9))
    assert index == pairs


def test_ties_take_the_smaller_key(spark):
    points = spark.createDataFrame([(i, [1.0]) for i in range(20)], "key long, v array<double>")
    query = spark.createDataFrame([(99, [1.0])], "key long, v array<double>")
    for block_rows in (3, 100):
        found = nearest_neighbors(query, "key", points, "key", "v", 4, block_rows).collect()
        assert sorted(r["neighbor"] for r in found) == [0, 1, 2, 3]


def test_votes_and_means(spark):
    train = spark.createDataFrame([(0, [0.0], 1), (1, [0.1], 0), (2, [5.0], 2), (3, [5.1], 2)], "key long, v array<double>, y int")
    test = spark.createDataFrame([(10, [0.05]), (11, [5.0])], "key long, v array<double>")
    classes = {r["key"]: r["prediction"] for r in knn_classify(train, test, "key", "v", "y", k=2).collect()}
    assert classes == {10: 0, 11: 2}  # one vote each: the smaller class
    means = {r["key"]: r["prediction"] for r in knn_regress(train, test, "key", "v", "y", k=2).collect()}
    assert means == {10: 0.5, 11: 2.0}


def test_imputation_from_neighbours(spark):
    rows = [(0, 1.0, 10.0), (1, 1.1, 20.0), (2, 9.0, 90.0), (3, 1.05, None), (4, None, None)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    filled = {r["k"]: r for r in impute_neighbors(df, ["a", "b"], "k", k=2).collect()}
    assert filled[3]["b"] == 15.0
    assert filled[4]["b"] == pytest.approx(40.0)  # shares nothing: the column mean
    assert filled[4]["a"] == pytest.approx((1.0 + 1.1 + 9.0 + 1.05) / 4)


def test_no_points(spark):
    empty = spark.createDataFrame([], "key long, v array<double>")
    query = spark.createDataFrame([(1, [1.0])], "key long, v array<double>")
    assert nearest_neighbors(query, "key", empty, "key", "v").count() == 0


def test_a_block_needs_no_object_per_number():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from gridloom.operators import neighbors

    rows = 20_000
    points = np.random.default_rng(3).normal(size=(rows, 32))
    theirs = pd.DataFrame({"__point": np.arange(rows), "__payload": np.zeros(rows), "__vector": list(points)})
    mine = pd.DataFrame({"__query": np.arange(300), "__vector": list(points[:300])})
    tracemalloc.start()
    found = neighbors._best(mine, theirs, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["__point"].tolist()[::2] == list(range(300))
    assert peak < 14 * points.nbytes
