"""Every registered query with SQL beside it gives what DuckDB gives."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from digestlake.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value.replace(tzinfo=None)) if isinstance(value, datetime.datetime) else repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found or name == "missing_blobs"
    if name in catalogue.ORACLES:
        told = duck.sql(catalogue.ORACLES[name])
        assert sorted(told.columns) == columns
        at = [told.columns.index(c) for c in columns]
        assert found == sorted(tuple(plain(r[k]) for k in at) for r in told.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
