"""The llm queries on the smallest test data: columns, no repeated rows, and SQL where there is some."""

import os

import pytest

from sheaf.llm import queries

SF = os.environ.get("SHEAF_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = {
    "p1_found": ["link_kind", "left_id", "right_id", "pos"], "p2_found": ["table_name", "record_id"], "p3_found": ["table_name", "record_id", "ref_id"], "p4_found": ["group_id", "field_name", "publication_id"],
    "p6_found": ["table_name", "record_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "band"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in queries.ORACLES:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "eval_items"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        assert sorted(rows) == sorted(con.execute(queries.ORACLES[name]).fetchall())
