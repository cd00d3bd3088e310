"""Odd table shapes through filters, charts, diagnosis, understanding and cleaning: none may raise."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators.filters import apply_filters, sanitize_missing
from gridloom.operators.profile import describe_categorical, describe_numeric, filter_domains, kpi_cards
from gridloom.functions.columns import numeric_columns, string_columns
from gridloom.plans.cleaning import auto_clean
from gridloom.plans.dashboard import ORDER_BY_KIND, chart_data
from gridloom.plans.report import diagnose, understand

INF, NAN = float("inf"), float("nan")
DAY = datetime.date
SHAPES = {
    "empty_rows": ("a double", []),
    "one_row": ("x double, y string", [(1.0, "only")]),
    "one_column_numeric": ("just_numbers double", [(1.0,), (2.0,), (3.0,)]),
    "one_column_text": ("just_text string", [("a",), ("b",), ("c",)]),
    "all_null": ("n double, s string", [(None, "x"), (None, "y")]),
    "all_text": ("name string, city string, note string", [("ann", "oslo", "?"), ("bob", "rome", "-")]),
    "all_numeric": ("a double, b double, c double", [(1.0, 3.0, 5.0), (2.0, 4.0, 6.0)]),
    "weird_names": (
        "`col with spaces` double, `Ünïcodé 🎉` string, `trailing ` double, row string, value double, col string",
        [(1.0, "a", 3.0, "p", 5.0, "r"), (2.0, "b", 4.0, "q", 6.0, "s")],
    ),
    "constant": ("k long, s string", [(7, "same")] * 3),
    "high_cardinality": ("id_text string, v long", [(f"row-{i}", i) for i in range(300)]),
    "inf_and_nan": ("x double, g string", [(1.0, "a"), (INF, "b"), (-INF, "a"), (NAN, "b")]),
    "bool_and_dates": (
        "flag boolean, when date, amount double",
        [(True, DAY(2020, 1, 1), 1.0), (False, DAY(2021, 1, 1), 2.0), (True, DAY(2022, 1, 1), 3.0)],
    ),
    "year_column": ("Year long, metric double", [(2019, 5.0), (2020, 6.0), (2021, 7.0)]),
    "mixed_junk": (
        "maybe_num string, maybe_date string, target string",
        [("1", "2020-01-01", "yes"), ("2", "not a date", "no"), ("N/A", "2021-02-02", "yes"), ("?", "", "no")],
    ),
}


@pytest.fixture(params=SHAPES)
def shape(request, spark, partitions):
    partitions(2)
    schema, rows = SHAPES[request.param]
    return request.param, spark.createDataFrame(rows, schema)


def test_filters(shape):
    _, df = shape
    for name in df.columns:
        wanted = (0.0, 10.0) if name in numeric_columns(df) else ["a", "x"]
        apply_filters(df, {name: wanted}).count()


def test_profile(shape):
    _, df = shape
    assert kpi_cards(df).first()["rows"] == df.count()
    if numeric_columns(df):
        assert describe_numeric(df).count() == len(numeric_columns(df))
    if string_columns(df):
        assert describe_categorical(df).count() == (len(string_columns(df)) if df.count() else 0)
    filter_domains(df).count()


def test_charts(shape):
    _, df = shape
    for kind in ORDER_BY_KIND:
        part, data = chart_data(df, kind, key=df.columns[:1])
        assert (part is None) == (data is None)


def test_diagnosis(shape):
    name, df = shape
    found = {(r["section"], r["item"], r["measure"]): r["value"] for r in diagnose(sanitize_missing(df)).collect()}
    for column in df.columns:
        assert ("missing", column, "count") in found
    if name == "inf_and_nan":
        assert found["missing", "x", "count"] == 3


def test_understanding(shape):
    _, df = shape
    understand(sanitize_missing(df)).collect()


def test_cleaning(shape):
    name, df = shape
    cleaned, report = auto_clean(df)
    assert report.steps[:4] == ["type_coercion", "missing_indicator_added", "imputation", "outlier_cap"]
    for column in cleaned.columns:
        lost = cleaned.where(F.col(f"`{column}`").isNull()).count()
        assert lost == 0 or name == "all_null"
