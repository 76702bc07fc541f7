"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from textwarden.plans import oracles
from textwarden.plans import queries as plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "conv_id" and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert rows == sorted((tuple(r[order.index(c)] for c in columns) for r in result.fetchall()),
                          key=repr)
