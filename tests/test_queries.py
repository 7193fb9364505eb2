"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from textloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return connection


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    own = QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    other = tables.execute(SQL[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in other.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in own.collect()), key=repr) == wanted
