"""Every query against DuckDB's answer to its SQL."""

import duckdb
import pytest

from rasterlake import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    assert not {t for _, t in df.dtypes} & {"int", "smallint", "float"}
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in Q.ORACLES:  # held against plain loops in test_study.py
        assert got[1]
        return
    e = duck.execute(Q.ORACLES[name])
    assert got == rows(e.fetchall(), [c[0] for c in e.description]) and got[1]


def test_partitions_change_nothing(spark):
    names = ("theoretical_minimum", "coalesce_groups", "byte_attribution")
    want = {n: rows([tuple(r) for r in Q.QUERIES[n](spark, SF).collect()], Q.QUERIES[n](spark, SF).columns) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert want == {n: rows([tuple(r) for r in Q.QUERIES[n](spark, SF).collect()], Q.QUERIES[n](spark, SF).columns) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
