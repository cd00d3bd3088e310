"""Row-local operators on a stream, and the windowed trend."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import clean, engineer
from gridloom.operators.filters import apply_filters, sanitize_missing
from gridloom.operators.models import CLASSIFIERS, fit_model, score_rows
from gridloom.streaming.trends import stream_trend

ORDERS = "/root/testdata/sf0.001/orders.parquet"


@pytest.fixture
def orders(spark):
    schema = spark.read.parquet(ORDERS).schema
    return spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/orders*")


def drained(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def row_local(df):
    df = apply_filters(sanitize_missing(df), {"o_orderstatus": ["F", "P"], "o_totalprice": (1000.0, 400000.0)})
    df = clean.add_missing_indicators(clean.coerce(df, to_bool=["o_orderstatus"]), ["o_orderstatus"])
    df = engineer.date_parts(engineer.log1p(engineer.ratio(df, "o_totalprice", "o_custkey"), "o_totalprice"), "o_orderdate")
    return df.withColumn("kind", text.question_kind(F.col("o_orderpriority")))


def test_row_local_operators_stream(spark, orders):
    streamed = drained(spark, row_local(orders), "row_local")
    batch = row_local(spark.read.parquet(ORDERS))
    assert batch.count() and streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_scoring_streams(spark, orders):
    batch = spark.read.parquet(ORDERS).withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    model = fit_model(batch, CLASSIFIERS["nb"], ["o_totalprice", "o_orderpriority"], "label", classes=2)
    scored = drained(spark, score_rows(model, orders, ["o_totalprice", "o_orderpriority"], "label"), "scored")
    assert scored.count() == batch.count()


@pytest.mark.parametrize("grain, unit", [("1d", "day"), ("1w", "week")])
def test_stream_trend(spark, orders, grain, unit):
    streamed = drained(spark, stream_trend(orders, "o_orderdate", "o_totalprice", grain=grain), f"trend_{unit}", "complete")
    batch = spark.read.parquet(ORDERS).groupBy(F.to_date(F.date_trunc(unit, "o_orderdate")).alias("d")).agg(F.sum("o_totalprice").alias("v"))
    got = {r["o_orderdate"]: round(r["o_totalprice"], 2) for r in streamed.collect()}
    assert got == {r["d"]: round(r["v"], 2) for r in batch.collect()}
    assert all(isinstance(d, datetime.date) for d in got)


def test_stream_trend_refuses_months(orders):
    with pytest.raises(ValueError):
        stream_trend(orders, "o_orderdate", "o_totalprice", grain="1mo")
