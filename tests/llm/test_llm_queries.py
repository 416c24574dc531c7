"""The pN_ queries against their SQL, over the smallest data."""

import glob
import os

import duckdb
import pytest

from cinequery.llm import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    found = queries.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert rows
    if name in oracles.oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{DATA}/*.parquet"):
            con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
        want = con.sql(f"select {', '.join(columns)} from ({oracles.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, rows)) == sorted(map(str, want))
