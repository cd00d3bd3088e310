"""Question tags, mentions and typo-tolerant names."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text


def tag(spark, build, *questions):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    return [r["v"] for r in df.select("i", build(F.col("q")).alias("v")).orderBy("i").collect()]


def test_kinds(spark):
    assert tag(spark, text.question_kind, "Sales TREND", "apples vs pears", "stop signs", "spread of x", "hello", None) == [
        "trend", "compare", "rank", "distribution", "trend", "trend"]


def test_grains_aggregates_metrics(spark):
    assert tag(spark, text.question_grain, "monthly", "by day and week", "annually", "never") == ["1mo", "1d", "1y", None]
    assert tag(spark, text.question_agg, "summary", "lowest total", "the mean", "none") == ["sum", "min", "mean", None]
    assert tag(spark, text.question_metric, "Revenue", "margin", "temp", "carbon", "x") == ["sales", "profit", "temperature", "co2", None]


def test_mentions(spark):
    names = ["Unit Price", "BMI", "order_date", "!!"]
    build = lambda q: text.mentioned(q, names)
    assert tag(spark, build, "price per unit", "the BMI-index", "dates reordered", "order the date", "") == [
        ["Unit Price"], ["BMI"], [], ["order_date"], []]


def test_close_names_forgive_one_slip(spark):
    names = ["BMI", "weight", "Height", "order_total"]
    questions = ["bmi vs wieght", "heigth and weight, weight", "order total", "nothing", "ordertotal", "wieghts", ""]
    expected = [["BMI", "weight"], ["Height", "weight"], [], [], ["order_total"], [], []]
    assert tag(spark, lambda q: text.closest_names(q, names), *questions) == expected
    assert tag(spark, lambda q: text.closest_names(q, []), "weight") == [[]]
