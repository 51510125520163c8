"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from swarmframe import oracles, queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.sql(oracles.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.select(*want.columns).collect()) == normal(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["partition_communities"])
def test_rows_only(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
