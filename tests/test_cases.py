"""Small cases with known answers: filters, charts, diagnosis, cleaning, features, metrics."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.columns import to_flag, to_number
from gridloom.operators import clean, engineer, metrics, prepare
from gridloom.operators.aggregate import compare, pivot_cross
from gridloom.operators.diagnose import (
    association_matrix,
    association_pairs, correlation_matrix, correlation_pairs, duplicate_report, missing_report, outlier_report,
)
from gridloom.operators.distribution import boxplot, histogram, nice_step, sample_rows, scatter
from gridloom.operators.filters import apply_filters, apply_question_filters
from gridloom.operators.prepare import encode_target
from gridloom.operators.profile import cardinality_map, convertible_text, describe_categorical, filter_domains, top_values
from gridloom.operators.roles import chart_roles, fairness_column, model_roles, pick_category, pick_metric
from gridloom.operators.trend import melt_years, text_trend, trend
from gridloom.operators.understand import (
    class_imbalance, effective_task, infer_target, infer_task, leakage_numeric, override_task, skew_report, skewness,
)
from gridloom.plans.cleaning import clean_dataset
from gridloom.plans.dashboard import chart_data, dashboard
from gridloom.plans.profile import question_profile
from gridloom.sources.datasets import Datasets, safe_name
from gridloom.sources.files import convert, read_csv, read_table, write_csv
from gridloom.session import scratch_path

D = datetime.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- filters

def test_membership_casts_to_text(spark):
    df = spark.createDataFrame([("petrol", 1), ("diesel", 2), ("petrol", 3)], "fuel string, value int")
    assert [r["value"] for r in apply_filters(df, {"fuel": ["petrol"]}).collect()] == [1, 3]
    assert [r["value"] for r in apply_filters(df, {"value": ["2"]}).collect()] == [2]
    assert apply_filters(df, {"fuel": []}).count() == 3


def test_ranges_are_closed_and_skip_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (5.0, 2), (9.0, 3), (None, 4), (float("nan"), 5)], "sales double, id int")
    assert [r["id"] for r in apply_filters(df, {"sales": (5.0, 9.0)}).collect()] == [2, 3]
    dated = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2021, 1, 1), 2), (D(2022, 1, 1), 3)], "date date, v int")
    assert [r["v"] for r in apply_filters(dated, {"date": (D(2020, 6, 1), D(2021, 6, 1))}).collect()] == [2]


def test_question_filter_ignores_unknown_columns(spark):
    df = spark.createDataFrame([("West",), ("East",)], "region string")
    assert apply_question_filters(df, {"region": "West", "nowhere": "x"}).count() == 1


# --- roles and charts

def test_chart_roles(spark):
    df = spark.createDataFrame([], "u32 bigint, i16 smallint, f32 float, flag boolean, name string, F1997 double, `1998` double")
    roles = chart_roles(df)
    assert roles.numeric == ["u32", "i16", "f32", "F1997", "1998"]
    assert roles.categories == ["flag", "name"] and roles.years == ["F1997", "1998"]


def test_default_columns(spark):
    df = spark.createDataFrame([], "idx int, total_margin double, city string")
    assert pick_metric(df, "profit") == "total_margin"
    assert pick_metric(df) == "idx" and pick_metric(df, preferred=["total_margin"]) == "total_margin"
    assert pick_category(df) == "city" and pick_metric(spark.createDataFrame([], "a string")) is None


def test_model_roles_and_fairness_column(spark):
    df = spark.createDataFrame([], "n int, t string, d date, ts timestamp, b boolean, Region string")
    roles = model_roles(df)
    assert (roles.numeric, roles.categorical, roles.datetime, roles.boolean) == (["n"], ["t", "Region"], ["d", "ts"], ["b"])
    assert fairness_column(df) == "Region"


def test_histogram_counts_every_value(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("v"))
    bins = histogram(df, "v").orderBy("bin").collect()
    expected, edges = np.histogram(np.arange(100_000.0), bins=30)
    assert [r["count"] for r in bins] == list(expected)
    np.testing.assert_allclose([r["bin_start"] for r in bins], edges[:-1])
    flat = histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v")
    assert flat.agg(F.sum("count"), F.min("bin_start"), F.max("bin_end")).first()[:] == (2, 1.5, 2.5)


def test_nice_steps():
    assert nice_step(0, 100) == 5 and nice_step(0, 29) == 1 and nice_step(900, 999.9) == 5


def test_scatter_cap_and_repeatability(spark):
    df = spark.range(25_000).select("id", F.col("id").cast("double").alias("aaa"), (F.col("id") * 2.0).alias("bbb"))
    assert scatter(df, "aaa", "bbb").count() == 25_000
    first = scatter(df, "aaa", "bbb", ["id"], cap=20_000)
    assert first.count() == 20_000
    assert rows(first) == rows(scatter(df.repartition(13), "aaa", "bbb", ["id"], cap=20_000))
    assert sample_rows(df, 30_000, ["id"]).count() == 25_000


def test_trend_aggregates_large_inputs(spark):
    df = spark.range(60_000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 30 as int))").alias("date"), (F.col("id") % 30).cast("double").alias("sales")
    )
    assert trend(df, "date", "sales").count() == 60_000  # raw rows pass, however many
    points = trend(df, "date", "sales", agg="mean").collect()
    assert len(points) == 30 and all(r["sales"] == r["date"].day - 1 for r in points)
    minutes = spark.range(60_000).select(
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("pickup_time"), F.lit(1.0).alias("fare")
    )
    assert trend(minutes, "pickup_time", "fare", agg="mean").count() <= 45


def test_trend_months_and_raw(spark):
    df = spark.range(60).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("date"), F.lit(1.0).alias("sales"))
    assert [r["sales"] for r in trend(df, "date", "sales", grain="1mo").collect()] == [31.0, 29.0]
    assert trend(df, "date", "sales").count() == 60


def test_text_dates_are_day_first(spark):
    df = spark.createDataFrame([("02/03/2024", 1.0), ("03-03-2024", 2.0), ("junk", 4.0), (None, 8.0)], "when string, v double")
    assert rows(text_trend(df, "when", "v", grain="1mo")) == [(D(2024, 3, 1), 3.0)]
    words = spark.createDataFrame([("q1", 1.0), ("q1", 2.0), ("q2", 4.0)], "when string, v double")
    assert rows(text_trend(words, "when", "v", agg="sum")) == [("q1", 3.0), ("q2", 4.0)]


def test_melt_years(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0)], "city string, `1997` double, F1998 double")
    assert rows(melt_years(df, ["1997", "F1998"])) == [("x", 1997, 1.0), ("x", 1998, 2.0)]


def test_compare_keeps_twenty_and_counts_all(spark):
    df = spark.range(300).select((F.col("id") % 25).cast("string").alias("c"), (F.col("id") % 25).cast("double").alias("m"))
    best = compare(df, "c", "m").collect()
    assert len(best) == 20 and best[0]["m"] == 24.0 and best[0]["total_categories"] == 25
    assert compare(df, "c", "m", limit=3, ascending=True).collect()[0]["m"] == 0.0


def test_all_null_sum_is_zero_and_null_level_is_kept(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", 2.0, None)], "g string, v double, k string")
    assert rows(pivot_cross(df, "g", "k", "v", "sum")) == [("a", None, 0.0), ("b", 2.0, None)]


def test_boxplot_outlier(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    box = boxplot(df, "g", "v").first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_high"], box["outliers"]) == (2.0, 3.0, 4.0, 4.0, 1)


def test_chart_choice_follows_the_question(spark):
    df = spark.createDataFrame([(D(2024, 1, i), float(i), "n") for i in range(1, 11)], "date date, sales double, region string")
    for kind, part in (("trend", "trend"), ("compare", "category"), ("rank", "category"), ("distribution", "histogram")):
        assert chart_data(df, kind, key=["date"])[0] == part
    plain = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert chart_data(plain, "compare", ["a"], numeric=["a", "b"])[0] == "scatter" or \
        chart_data(plain, "compare", ["a"], numeric=["a", "b"])[0] == "named_scatter"


def test_dashboard_cross_filter(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("a", "y", 3.0)], "c string, d string, sales double")
    board = dashboard(df, {}, key=["c"], selected=["a"])
    assert board["kpis"].first()["rows"] == 2 and board["category"].count() == 2
    assert rows(board["drill_down"]) == [("x", 1.0, 2), ("y", 3.0, 2)]


def test_question_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, s string")
    parts = question_profile(df, ["n"])
    assert rows(parts["columns"]) == [("n", "int"), ("s", "string")]
    assert rows(parts["top_values"].select("value", "n")) == [("a", 2), ("b", 1)]


# --- diagnosis

def test_missing_duplicates_outliers(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, float("nan"))], "a double, b double")
    assert [(r["column"], r["missing_count"]) for r in missing_report(df).collect()] == [("b", 3), ("a", 1)]
    twice = spark.createDataFrame([(1, 3), (1, 3), (2, 4)], "a int, b int")
    assert duplicate_report(twice).first()[:] == (1, pytest.approx(1 / 3))
    x = spark.createDataFrame([(1,), (2,), (3,), (100,)], "x int")
    assert outlier_report(x).first()["outlier_count"] == 1


def test_correlation_survives_constant_column(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 4, 1), (3, 6, 1)], "a int, b int, c int")
    assert rows(correlation_pairs(df)) == [("a", "b", pytest.approx(1.0))]
    matrix = {(r["column_a"], r["column_b"]): r["value"] for r in correlation_matrix(df).collect()}
    assert len(matrix) == 9 and matrix["c", "c"] is None and matrix["a", "a"] == pytest.approx(1.0)


def test_correlation_is_pairwise_complete(spark):
    data = pd.DataFrame({"a": [1.0, 2, None, 4, 5], "b": [2.0, 1, 4, None, 3], "c": [1.0, 0, 1, 0, 2]})
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, c double")
    expected = data.corr().abs()
    for r in correlation_matrix(df).collect():
        assert r["value"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]])


def test_association_pairs(spark):
    df = spark.createDataFrame([("x", "m", "a"), ("x", "m", "b"), ("y", "n", "a"), ("y", "n", "b")], "cat1 string, cat2 string, cat3 string")
    assert [(r["column_a"], r["column_b"]) for r in association_pairs(df, df.columns, 0.5).collect()] == [("cat1", "cat2")]


def test_imbalance_skew_leakage(spark):
    y = spark.createDataFrame([(int(i >= 90),) for i in range(100)], "y int")
    assert {(r["class"], r["n"], r["ratio"], r["is_imbalanced"]) for r in class_imbalance(y, "y").collect()} == {
        ("0", 90, 0.1, True), ("1", 10, 0.1, True)}
    data = pd.DataFrame({"skewed": [2.0 ** (i % 10) for i in range(100)], "balanced": range(100)})
    df = spark.createDataFrame(data)
    assert [r["column"] for r in skew_report(df).collect()] == ["skewed"]
    assert skewness(df, ["skewed"]).first()["skew"] == pytest.approx(data["skewed"].skew())
    leak = spark.createDataFrame([(i, (i * 7) % 5, 2 * i) for i in range(5)], "leak int, noise int, target int")
    assert [r["feature"] for r in leakage_numeric(leak, "target").collect()] == ["leak"]


def test_target_and_tasks(spark):
    df = spark.createDataFrame([(1, "x", 1.5, True), (2, "y", 2.5, False)], "row_id int, kind string, price double, flag boolean")
    assert infer_target(df) == "flag" and infer_target(df, "kind") == "kind"
    assert infer_target(df.select("row_id", "price")) is None
    assert infer_task(df, "price") == "classification" and infer_task(df, "flag") == "classification"
    assert effective_task(df, "price") == "regression" and effective_task(df, "row_id") == "classification"
    many = spark.range(100).select(F.col("id").cast("string").alias("s"))
    assert override_task(many, "s") == "regression" and infer_task(spark.range(30), "id") == "regression"


def test_convertible_text_and_top_values(spark):
    df = spark.createDataFrame([("1", "a"), ("2.5", "b"), ("N/A", "a")], "t string, s string")
    found = {r["column"]: r["convertible"] for r in convertible_text(df).collect()}
    assert found == {"t": True, "s": False}
    assert rows(top_values(df, ["s"], limit=1)) == [("s", "a", 2, 1)]
    assert cardinality_map(df) == {"t": 3, "s": 2}


# --- cleaning

def test_coercions(spark):
    texts = ["1", " 12 ", "1,234", "1d", "1e3", "-.5", "inf", "", "N/A", "0x1F", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.orderBy("i").select(to_number(F.col("t")).alias("v")).collect()]
    assert got == [1.0, 12.0, None, None, 1000.0, -0.5, float("inf"), None, None, None, None]
    flags = spark.createDataFrame([("TRUE",), ("0",), ("yes",), (None,)], "t string").select(to_flag(F.col("t")).alias("v"))
    assert [r["v"] for r in flags.collect()] == [True, False, None, None]


def test_imputation_and_indicators(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "b")], "x double, cat string")
    assert [r["x"] for r in clean.impute(df, ["x"]).collect()] == [1.0, 2.0, 3.0]
    assert [r["cat"] for r in clean.fill_text(df, ["cat"]).collect()] == ["a", "Unknown", "b"]
    flagged = clean.add_missing_indicators(df, ["x", "cat"])
    assert flagged.agg(F.sum("x_missing"), F.sum("cat_missing")).first()[:] == (1, 1)


def test_capping_and_column_drops(spark):
    df = spark.createDataFrame([(float(v), 1, None) for v in (1, 2, 3, 100)], "x double, k int, e string")
    assert clean.cap_outliers(df, ["x"]).agg(F.max("x")).first()[0] == pytest.approx(27.25 + 1.5 * 25.5)
    assert clean.constant_columns(df) == ["k", "e"]
    sparse = spark.range(100).select("id", (F.col("id") > 96).alias("rare"), (F.col("id") > 50).alias("half"))
    assert clean.sparse_columns(sparse) == ["rare"]
    mostly_null = spark.range(100).select("id", F.when(F.col("id") > 96, F.col("id")).alias("v"))
    assert clean.sparse_columns(mostly_null) == ["v"]


def test_clean_dataset(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "b"), (100.0, "b")], "num double, cat string")
    cleaned, report = clean_dataset(df, ["num", "gone"], ["cat"])
    assert cleaned.where("num is null or cat is null").count() == 0 and "num_missing" in cleaned.columns
    assert "drop_duplicates" not in report.steps and report.notes and report.outlier_capped == ["num"]
    again, _ = clean_dataset(cleaned, ["num"], ["cat"], indicators=False)
    assert again.count() == cleaned.count()


def test_clean_dataset_with_neighbours_and_duplicates(spark):
    df = spark.createDataFrame([(i, float(i % 4), None if i == 3 else float(i)) for i in range(8)], "k long, a double, b double")
    cleaned, report = clean_dataset(df, ["a", "b"], [], strategy="knn", key="k")
    assert cleaned.where("b is null").count() == 0 and report.imputation["numeric"] == "knn"
    twice = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "c string, v double")
    assert clean_dataset(twice, ["v"], ["c"])[1].dropped_duplicates == 1


# --- feature engineering

def test_engineered_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (4.0, 2.0, "x"), (9.0, 2.0, "y")], "a double, b double, cat string")
    one = lambda d, c: [r[c] for r in d.orderBy("a").collect()]
    assert one(engineer.square(df, "a"), "a_sq") == [1.0, 16.0, 81.0]
    assert one(engineer.ratio(df, "a", "b"), "a_per_b") == [0.5, 2.0, 4.5]
    assert one(engineer.difference(df, "a", "b"), "a_minus_b") == [-1.0, 2.0, 7.0]
    assert one(engineer.frequency(df, "cat"), "cat_count") == [2, 2, 1]
    assert one(engineer.min_max(df, "a"), "a_01") == [0.0, 0.375, 1.0]
    assert one(engineer.quantile_bins(df, "a", 2), "a_bin") == ["(-inf, 4]", "(-inf, 4]", "(4, inf]"]
    assert one(engineer.one_hot(df, "cat"), "cat_x") == [1, 1, 0]


def test_division_and_logarithm_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (-3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r["a_per_b"] for r in engineer.ratio(df, "a", "b").collect()]
    assert got[:2] == [float("inf"), float("-inf")] and np.isnan(got[2]) and got[3:] == [-1.5, None]
    logs = [r["log_a"] for r in engineer.log1p(df, "a").collect()]
    assert logs[1] == float("-inf") and np.isnan(logs[3]) and logs[4] is None
    big = spark.createDataFrame([(2_000_000_000,)], "n int")
    assert engineer.square(big, "n").first()["n_sq"] == 4 * 10**18


def test_one_hot_refuses_many_levels(spark):
    with pytest.raises(ValueError):
        engineer.one_hot(spark.range(30).select(F.col("id").cast("string").alias("c")), "c")


# --- preparation

def test_identifiers_and_epochs(spark):
    df = spark.createDataFrame([(i, f"u{i}", float(i), "ab"[i % 2]) for i in range(20)], "row_id int, token string, v double, g string")
    assert prepare.identifier_columns(df) == ["row_id", "token"]
    assert prepare.identifier_columns(df.select("row_id")) == []
    times = spark.createDataFrame([(datetime.datetime(1970, 1, 2),), (None,)], "when timestamp_ntz")
    assert [r["when"] for r in prepare.epochize(times).collect()] == [86400.0, None]


def test_target_codes(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "y string")
    assert prepare.target_classes(df, "y") == ["x", "y"]
    assert [r["y_code"] for r in prepare.encode_target(df, "y").collect()] == [0, 1, 0]


def test_many_levels_are_numbered_across_partitions(spark, monkeypatch):
    levels = spark.range(500).select(F.format_string("k%04d", (F.col("id") * 37) % 500).alias("v"), F.lit(1).alias("__rows"))
    monkeypatch.setattr(prepare, "ONE_TASK_LEVELS", 10)
    coded = {r["v"]: r["code"] for r in prepare.level_codes(levels, "v").collect()}
    assert coded == {f"k{i:04d}": i for i in range(500)}


def test_encoder_folds_rare_levels(spark):
    data = [(f"l{i:02d}", float(i)) for i in range(25) for _ in range(i + 1)] + [(None, None)]
    df = spark.createDataFrame(data, "c string, v double")
    model = prepare.feature_encoder(df, ["v", "c"]).fit(df)
    kept = [v for _, v in model.level_rows()]
    assert kept == [f"l{i:02d}" for i in range(6, 25)] + ["<rare>"]
    new = spark.createDataFrame([("unseen", None), (None, 1.0)], "c string, v double")
    first, second = (r["features"].toArray() for r in model.transform(new).collect())
    assert first[-1] == 1.0 and first[0] == np.median([v for _, v in data if v is not None])
    assert second[1:].tolist() == [0.0] * 18 + [1.0, 0.0]  # the most frequent level fills the gap


# --- metrics

def test_fairness_over_three_classes(spark):
    pairs = list(zip([0, 1, 2, 0, 1, 2, 0, 1], [0, 1, 2, 0, 0, 0, 0, 1], "aaaabbbb"))
    df = spark.createDataFrame(pairs, "t int, p int, g string")
    groups = metrics.group_class_metrics(df, "t", "p", "g")
    found = {r["g"]: r for r in groups.collect()}
    assert found["a"]["accuracy"] == 1.0 and found["b"]["accuracy"] == 0.5 and found["b"]["n"] == 4
    assert metrics.disparity(groups, "accuracy", 0.1).first()["alert"]
    assert not metrics.disparity(groups, "accuracy", 0.6).first()["alert"]


def test_binary_metrics_without_hits(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int")
    assert metrics.class_metrics(df, "t", "p").first()[:] == (0.0, 0.0, 0.0, 0.5, 2)


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    truth, score = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 10.0
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(truth, score)], "t int, s double")
    found = metrics.ranking_metrics(df, "t", "s").first()
    pos, neg = score[truth == 1], score[truth == 0]
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert found["roc_auc"] == pytest.approx(wins)
    precision = 0.0
    for s in np.unique(score):
        precision += (pos == s).mean() * (pos >= s).sum() / (score >= s).sum()
    assert found["pr_auc"] == pytest.approx(precision)
    assert metrics.ranking_metrics(df.where("t = 1"), "t", "s").first()[:] == (None, None)


def test_error_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    got = metrics.error_metrics(df, "y", "p").first()
    assert got[:] == (pytest.approx((2 / 3) ** 0.5), pytest.approx(2 / 3), pytest.approx(0.75), pytest.approx(40.0), 3)


# --- sources

def test_csv_types_and_conversion(spark):
    path = scratch_path(spark, "typed") + ".csv"
    src = spark.createDataFrame(
        [(1, 1.5, "x", True, D(2024, 1, 2)), (2, None, "y", False, D(2024, 1, 3))], "i long, f double, s string, b boolean, d date"
    )
    write_csv(src, path)
    back = read_table(spark, path)
    assert back.schema.simpleString() == "struct<i:bigint,f:double,s:string,b:boolean,d:date>" and rows(back) == rows(src)
    target = scratch_path(spark, "converted") + ".parquet"
    convert(spark, path, target)
    assert rows(read_table(spark, target)) == rows(src)
    with pytest.raises(ValueError):
        read_table(spark, "table.xlsx")


def test_csv_text_comes_back_unchanged(spark):
    odd = [" lead", "trail ", "", None, 'say "hi", ok', "two\nlines", "a,b", "\\", '"', "tab\t", "NaN", "é"]
    src = spark.createDataFrame(list(enumerate(odd)), "i long, s string")
    path = scratch_path(spark, "odd-text")
    write_csv(src, path)
    assert rows(read_csv(spark, path)) == rows(src)
    plain = scratch_path(spark, "plain") + ".csv"
    spark.createDataFrame([('"i","s"',), ('1,"say ""hi"", ok"',)], "value string").coalesce(1).write.text(plain)
    assert rows(read_csv(spark, plain)) == [(1, 'say "hi", ok')]


def test_csv_types_come_from_every_row(spark):
    path = scratch_path(spark, "late-type")
    values = spark.range(10_001).selectExpr("if(id = 10000, '1.5', cast(id as string)) as v").coalesce(1)
    write_csv(values, path)
    back = read_csv(spark, path)
    assert back.schema.simpleString() == "struct<v:double>" and back.agg(F.max("v"), F.count("v")).first()[:] == (9999.0, 10_001)


def test_csv_value_that_breaks_a_given_type_raises(spark):
    path = scratch_path(spark, "late")
    write_csv(spark.createDataFrame([("1",), ("x",)], "v string").coalesce(1), path)
    from pyspark.sql import types as T
    with pytest.raises(Exception):
        read_csv(spark, path, T.StructType([T.StructField("v", T.LongType())])).collect()


def test_dataset_store(spark):
    store = Datasets(spark, scratch_path(spark, "workspace"))
    name = store.add("sales", spark.range(3))
    assert store.derive(name, spark.range(2)) == "sales (cleaned)" and store.names() == ["sales", "sales (cleaned)"]
    assert safe_name('a/b:c?') == "a_b_c_" and safe_name("  ") == "dataset"
    store.save()
    store.remove("sales")
    assert store.names() == ["sales (cleaned)"] and store.load("sales").count() == 3
    store.save()  # a set that is read from its own folder
    assert store.get("sales").count() == 3 and store.load("sales").count() == 3
    store.add("sales", store.get("sales").where("id > 0"))
    store.save()
    assert store.get("sales").count() == 2 and store.load("sales").count() == 2


def test_confusion_matrix_keeps_every_label(spark):
    df = spark.createDataFrame([("a", "z"), ("q", "a"), ("a", "a"), (None, "a")], "y string, p string")
    table = {r["actual"]: r.asDict() for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert set(table) == {"a", "q", "z"} and (table["a"]["z"], table["q"]["a"], table["a"]["a"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        metrics.confusion_matrix(df, "y", "p", ["a", "q"])


def test_nothing_is_left_out_by_size(spark):
    wide = spark.range(3).select(*[(F.col("id") * 1.5 + i).alias(f"v{i}") for i in range(20)])
    assert filter_domains(wide).count() == 20
    texts = spark.createDataFrame([("x", None), ("x", None)], "a string, b string")
    assert rows(describe_categorical(texts)) == [("a", 2, 1, "x", 2), ("b", 0, 0, None, None)]
    levels = spark.range(400).selectExpr("cast(id % 150 as string) as many", "cast(id % 3 as string) as few")
    assert association_matrix(levels, ["many", "few"]).count() == 4
    coded = encode_target(spark.range(20_000).selectExpr("lpad(cast(id as string), 6, '0') as y"), "y")
    assert coded.agg(F.count_distinct("y_code"), F.max("y_code")).first()[:] == (20_000, 19_999)
