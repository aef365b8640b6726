"""Every core query against its SQL on the smallest test data, where those are present."""

import os

import pytest

from sheaf.plans import catalogue

SF = os.environ.get("SHEAF_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(value):
    if isinstance(value, list):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return str(value)[:26].replace("+00:00", "")
    return value


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order([tuple(r) for r in df.collect()], df.columns) == in_order(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(name, spark):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0
