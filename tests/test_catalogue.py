"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lingualake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    expected = tables.sql(catalogue.SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[k] for k in at) for r in expected.fetchall()), key=repr)
