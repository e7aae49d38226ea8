"""Every catalogue query against its SQL in DuckDB, on the smallest standard tables."""

import os

import duckdb
import pytest

from millrace.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no standard tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    order = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert rows == want
