import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from peerlens import queries as Q
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, DATA)
    order, con = sorted(got.columns), duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(Q.oracle_sql()[name]).select(*(f'"{c}"' for c in order)).fetchall()
    assert sorted(map(tuple, got.select(*order).collect()), key=str) == sorted(want, key=str)


def _whole(name):
    """Rows of a query, and those of its SQL without the cut to firms whose id is divisible by 20."""
    con, sql = duckdb.connect(), Q.oracle_sql()[name]
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    for cut in (" AND CAST(firm AS BIGINT) % 20 = 0", " WHERE CAST(focal_firm AS BIGINT) % 20 = 0"):
        sql = sql.replace(cut, "")
    assert "% 20" not in sql
    return con.sql(sql)


def test_eval_summary_counts_all_focal_firms(spark):
    got, want = Q.queries()["eval_summary"](spark, DATA), _whole("eval_summary")
    assert [tuple(r) for r in got.select(*want.columns).collect()] == want.fetchall()


def test_labels_with_analysts_of_all_focal_firms(spark):
    got, want = Q.queries()["labels_with_analysts"](spark, DATA), _whole("labels_with_analysts")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
