import glob
import os

import duckdb
import pytest

from peerlens.llm import queries as Q
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        want = con.sql(Q.oracle_sql()[name])
        assert want.columns == got.columns
        assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
    assert rows
