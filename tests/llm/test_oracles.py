"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from rasterlake.llm import queries as Q

from .conftest import SF


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    e = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in e.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(e.fetchall())
