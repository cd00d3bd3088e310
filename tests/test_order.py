"""Order statistics, running totals, splits and statistics joins against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import brackets, split
from gridloom.operators.attach import attach
from gridloom.operators.engineer import frequency
from gridloom.operators.order import quantile_map, quantiles, range_splits, running_totals


def skewed_rows(n=3000, seed=1):
    """A third of the rows share one group, and in it many share one value."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = 0.0 if rng.random() < 0.3 else rng.choice([rng.uniform(-5, 5), float(rng.randrange(4)), None])
        rows.append((i, group, value))
    return rows


@pytest.mark.parametrize("limit", [0, 10**9])
def test_grouped_quantiles_match_numpy(spark, limit):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id long, g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: r for r in quantiles(df, ["v"], probs, by=["g"], limit=limit).collect()}
    assert set(found) == {"hot", "a", "b", None}
    for g, row in found.items():
        values = [v for _, k, v in rows if k == g and v is not None]
        assert row["n"] == len(values)
        np.testing.assert_allclose(row["q"], np.percentile(values, [p * 100 for p in probs]), rtol=1e-12)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_quantiles_of_empty_and_null_groups(spark, limit):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, float("nan"))], "g string, v double, w double")
    found = {r["column"]: r for r in quantiles(df, ["v", "w"], [0.5], by=["g"], limit=limit).collect()}
    assert found["v"]["n"] == 0 and found["v"]["q"] in (None, [None])
    assert found["w"]["n"] == 1 and found["w"]["q"] == [1.0]
    assert quantile_map(df.limit(0), ["v"], [0.5]).get("v") in (None, [None])


@pytest.mark.parametrize("shuffle", [1, 8, 200])
def test_quantiles_do_not_depend_on_partitions(spark, partitions, shuffle):
    partitions(shuffle)
    df = spark.range(2000).select((F.col("id") * 7919 % 1009).cast("double").alias("v"))
    found = quantiles(df, ["v"], [0.25, 0.5, 0.75], limit=0).first()["q"]
    np.testing.assert_allclose(found, np.percentile([i * 7919 % 1009 for i in range(2000)], [25, 50, 75]))


def test_running_totals(spark):
    rows = [(float(i), i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, w long").repartition(7)
    totals = {r["v"]: r for r in running_totals(df, "v", ["w"], splits=range_splits(df, "v")).collect()}
    for v, w in rows:
        assert totals[v]["below_w"] == sum(x for u, x in rows if u < v)
        assert totals[v]["all_w"] == sum(x for _, x in rows)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_statistics_reach_hot_and_null_keys(spark, limit):
    rows = skewed_rows(1200)
    df = spark.createDataFrame(rows, "id long, g string, v double")
    found = {r["id"]: r["g_count"] for r in frequency(df, "g", limit=limit).collect()}
    assert len(found) == len(rows)
    for i, g, _ in rows:
        assert found[i] == sum(1 for _, k, _ in rows if k == g)


def test_attach_splits_off_rare_keys(spark):
    df = spark.createDataFrame([(i, "hot" if i < 3000 else f"k{i}") for i in range(4500)], "id long, k string")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert attach(df, stats, ["k"], rows="n", limit=0).groupBy().agg(F.sum("n"), F.count("id")).first()[:] == (
        3000 * 3000 + 1500, 4500)


def test_stratified_split_keeps_class_shares(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(900)], "id long, y string")
    parts = split.stratified_split(df, "y", ["id"]).groupBy("y").agg(F.count_if("is_train").alias("t"), F.count("y").alias("n"))
    assert {r["y"]: (r["t"], r["n"]) for r in parts.collect()} == {"big": (480, 600), "small": (240, 300)}


def test_single_row_class_falls_back_to_random(spark):
    df = spark.createDataFrame([(i, "only" if i == 0 else "rest") for i in range(50)], "id long, y string")
    assert split.stratified_split(df, "y", ["id"]).collect() == split.random_split(df, ["id"]).collect()


def test_folds_are_disjoint_and_complete(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4).cast("int"))
    folds = split.stratified_kfold(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]) for r in folds} == {(y, f) for y in range(4) for f in range(5)}
    assert {r["count"] for r in folds} == {50}


@pytest.mark.parametrize("times", [1, 3, 1000])
def test_time_split_with_ties(spark, times):
    df = spark.range(1000).select("id", (F.col("id") % times).alias("t"))
    parts = split.time_split(df, "t", ["id"], 0.7)
    assert parts.where("is_train").count() == 700
    latest = parts.where("is_train").agg(F.max("t")).first()[0]
    earliest = parts.where("not is_train").agg(F.min("t")).first()[0]
    assert latest <= earliest


def test_time_folds_expand(spark):
    df = spark.createDataFrame([(i, None if i == 5 else f"2024-01-{i + 1:02d}") for i in range(10)], "id long, d string")
    blocks = split.time_folds(df.withColumn("d", F.to_date("d")), "d", ["id"], 3).collect()
    assert sorted(r["block"] for r in blocks) == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]
    assert next(r["block"] for r in blocks if r["id"] == 5) == 3  # no date sorts last


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_bracketed_quantiles_match_numpy(spark, monkeypatch, accuracy):
    """Distinct, tied, constant, empty and infinite columns; small sketches narrow a bracket more than once."""
    for name, value in (("ACCURACY", accuracy), ("SLACK", 2 / accuracy), ("FEW_ROWS", 2 * accuracy), ("COLUMNS_AT_ONCE", 4)):
        monkeypatch.setattr(brackets, name, value)
    counted, real = [], brackets._count
    monkeypatch.setattr(brackets, "_count", lambda v, b: counted.append([x.inside for x in b]) or real(v, b))
    rng = np.random.default_rng(5)
    n = 30_000
    data = {"distinct": rng.normal(size=n), "tied": rng.integers(0, 5, n).astype(float), "same": np.full(n, 2.5),
            "holes": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n)),
            "far": np.where(rng.random(n) < 0.4, -np.inf, rng.normal(size=n)), "none": np.full(n, np.nan)}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.7501, 1.0]
    found = {r["column"]: r for r in quantiles(df, list(data), probs, limit=0).collect()}
    for c, values in data.items():
        kept = values[~np.isnan(values)]
        assert found[c]["n"] == len(kept)
        if c == "none":
            assert found[c]["q"] is None
            continue
        ordered = np.sort(kept)
        for p, q in zip(probs, found[c]["q"]):
            spot = (len(kept) - 1) * p
            low, high = ordered[int(np.floor(spot))], ordered[int(np.ceil(spot))]
            assert q == (low if low == high else low + (high - low) * (spot - np.floor(spot))), (c, p)
    assert len(counted) == (2 if accuracy == 100 else 1)


def test_a_rank_between_two_shared_values_ends(spark, monkeypatch):
    """The median lies between two values that more rows share than a bracket may hold; so does a quartile, in part."""
    for name, value in (("ACCURACY", 100), ("SLACK", 2 / 100), ("FEW_ROWS", 200)):
        monkeypatch.setattr(brackets, name, value)
    passes, real = [], brackets._count

    def count(values, some):
        passes.append(len(some))
        assert len(passes) < 6, "brackets do not shrink"
        return real(values, some)

    monkeypatch.setattr(brackets, "_count", count)
    n = 8_000
    data = {"halves": np.arange(n) % 2.0, "uneven": np.where(np.arange(n) < n // 4, -1.0, np.arange(n) // 1_000),
            "between": np.where(np.arange(n) < n // 2 - 1, 0.0, np.where(np.arange(n) < n // 2 + 1, 3.0, 7.0)),
            "one_side": np.where(np.arange(n) < n // 2, 0.0, np.arange(n))}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(5)
    found = {r["column"]: list(r["q"]) for r in quantiles(df, list(data), [0.25, 0.5, 0.75], limit=0).collect()}
    assert found == {c: np.quantile(v, [0.25, 0.5, 0.75]).tolist() for c, v in data.items()}


def test_missed_brackets_are_located_instead(spark, monkeypatch):
    monkeypatch.setattr(brackets, "FEW_ROWS", 10)
    monkeypatch.setattr(brackets, "_count", lambda v, b: False)
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert quantiles(df, ["v"], [0.25, 0.5], limit=0).first()["q"] == [25.0, 50.0]
