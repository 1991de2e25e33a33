"""Queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lattice.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("null" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())
