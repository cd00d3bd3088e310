"""Every registered query against its SQL; queries without SQL must run and return rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DIRECTORY}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result_as_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, DIRECTORY), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert not QUERIES[name](spark, DIRECTORY).isEmpty()


def test_flagship(spark):
    assert contract.entry(spark).columns == ["o_orderdate", "o_totalprice"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
