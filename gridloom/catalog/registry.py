"""The registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a key, with its SQL when there is one."""

    def register(build):
        QUERIES[name] = lambda spark, directory: build(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, so that engines that add in another order agree."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(f"`{c}`") for c in df.columns])
