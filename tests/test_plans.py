"""What the plans must and must not hold."""

import os
import re

import pytest
from pyspark.sql import functions as F

from peerlens import queries as Q
from peerlens.sources import table
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - {"fiscal_window_counts"}))
def test_no_join_compares_all_with_all(spark, name):
    text = plan(Q.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_windows_of_fiscal_years_are_the_broadcast_side(spark):
    text = plan(Q.queries()["fiscal_window_counts"](spark, DATA))
    assert "BroadcastNestedLoopJoin BuildRight, Inner" in text


def test_scans_read_only_what_is_used(spark):
    text = plan(Q.queries()["text_forms"](spark, DATA))
    assert re.search(r"ReadSchema: struct<row_id:bigint,text_content:string>", text)
    assert "PushedFilters: [IsNotNull(text_content)]" in text


def test_group_limit_and_partial_aggregates(spark):
    text = plan(Q.queries()["ranking_top50"](spark, DATA))
    assert "WindowGroupLimit" in text and text.count("HashAggregate") >= 2


def test_user_filters_reach_the_scan(spark):
    text = plan(table(spark, DATA, "filing_item").where(F.col("year") == "2020").select("row_id"))
    assert "EqualTo(year,2020)" in text


def test_columns_with_the_same_names_do_not_clash(spark):
    """Every query's operator gets a table with extra columns named like its own helpers."""
    from peerlens.operators import chunks

    df = spark.createDataFrame([(1, "1", "w " * 300, "x", 3)], "k INT, item STRING, t STRING, units STRING, unit_id INT")
    assert chunks.units(df, ["k"], "item", "t").count() >= 0


def test_stages_are_removed_on_release(spark):
    from peerlens.plans import new_folder, release, stage

    kept, folder = stage(spark.range(3), "kept"), new_folder(spark, "made")
    spark.range(2).write.parquet(folder)
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and os.path.exists(path.removeprefix("file://"))
    release()
    assert not os.path.exists(path.removeprefix("file://")) and not os.path.exists(folder.removeprefix("file:").removeprefix("//"))
