"""The given tables with missing values put in by a fixed rule, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_when(key: str, divisor: int, column: str):
    return F.when(F.col(key) % divisor != 0, F.col(column)).alias(column)


def holed_customer(t) -> DataFrame:
    return t("customer").select(
        "c_custkey", null_when("c_custkey", 5, "c_name"), "c_nationkey",
        null_when("c_custkey", 7, "c_acctbal"), null_when("c_custkey", 11, "c_mktsegment"),
    )


HOLED_CUSTOMER = """
  select c_custkey,
    case when c_custkey % 5 <> 0 then c_name end as c_name,
    c_nationkey,
    case when c_custkey % 7 <> 0 then c_acctbal end as c_acctbal,
    case when c_custkey % 11 <> 0 then c_mktsegment end as c_mktsegment
  from customer
"""


def odd_events(t) -> DataFrame:
    """Events with NaN and infinite values."""
    key, value = F.col("event_id"), F.col("value")
    return t("events").select(
        "event_id",
        F.when(key % 11 == 0, float("nan")).when(key % 13 == 0, float("inf"))
        .when(key % 17 == 0, float("-inf")).otherwise(value).alias("value"),
    )


ODD_EVENTS = """
  select event_id,
    case when event_id % 11 = 0 then 'nan'::double when event_id % 13 = 0 then 'inf'::double
         when event_id % 17 = 0 then '-inf'::double else value end as value
  from events
"""
