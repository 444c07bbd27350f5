"""Every reference query against its SQL twin in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from siftline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    assert got == sorted(tuple(plain(row[k]) for k in order) for row in want.fetchall())


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
