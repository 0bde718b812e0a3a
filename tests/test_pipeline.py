"""The commands one after the other on a small tree of filings, and the sources, sinks and streams on files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens import cli
from peerlens.operators import index_records
from peerlens.sources import files, matrices, remote, sinks
from peerlens.streaming import ingest
from tests.test_html import filing

TOPICS = {"0000000001": "steel rails and bridges", "0000000002": "steel bridges and beams", "0000000003": "cloud software and services"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("filings")
    for cik, topic in TOPICS.items():
        for year in (2021, 2022):
            folder = root / cik / str(year) / "10-K"
            folder.mkdir(parents=True)
            body = "".join(f"<p>In {year} we sold {topic} to customer {i} of many. " + f"The {topic} market grew. " * 40 + "</p>" for i in range(4))
            html = filing(("1", "Business", "i1", body), ("1A", "Risk Factors", "i1a", "<p><b>We may fail.</b></p><p>" + f"{topic} may be hard to sell. " * 40 + "</p>"), ("7", "Discussion", "i7", "<p>We earned money.</p>"))
            (folder / f"{cik}_{year}_10-K.htm").write_text(html)
    return root


def test_commands(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert sum(r["items"] for r in run("extract", "--filing_dir", tree, "--out", out).collect()) == 18
    assert spark.read.parquet(f"{out}/nodes").where("heading = 'We may fail.'").count() == 6
    run("extract", "--filing_dir", tree, "--out", out)
    assert spark.read.parquet(f"{out}/items").count() == 18  # the second run adds nothing
    json_root = tmp_path / "json"
    run("extract", "--filing_dir", tree, "--out", out, "--json", json_root)
    assert files.item_files(spark, str(json_root)).count() == 18 and files.structure_files(spark, str(json_root)).count() == spark.read.parquet(f"{out}/nodes").count()
    run("summarize", "--out", out, "--json", json_root)
    assert files.summary_files(spark, str(json_root)).count() == 18
    done = spark.read.parquet(f"{out}/summaries")
    assert done.count() == 18 and done.where("previous_year_available").count() == 9
    for scope in ("all", "summary", "heading", "body"):
        run("vectors", "--out", out, "--scope", scope, "--dim", 64, "--min_unit_tokens", 2, "--min_units_per_item", 1, "--matrices", tmp_path / "npz")
    assert matrices.read_matrices(spark, str(tmp_path / "npz" / "all")).count() == 18
    table = spark.read.parquet(f"{out}/item_vectors")
    assert table.where("scope = 'all'").count() == 18 and table.where("scope = 'summary'").count() == 18
    got = run("peers", "--out", out, "--focalfirm", "1", "--year", 2022, "--item", "1", "1a", "--peer_path", f"{out}/peers", "--q_share", "0.5", "--top_share", "1").orderBy("rank").collect()
    assert [r.peer_firm for r in got][0] == "0000000002" and got[0].items_matched == 2
    metadata = tmp_path / "meta.csv"
    metadata.write_text("firm_id,year,sic\n0000000001,2022,10\n0000000002,2022,10\n")
    total = run("evaluate", "--peer_path", f"{out}/peers.parquet", "--metadata_path", metadata, "--out", out).first()
    assert total.recall_at_50 == 1.0 and spark.read.json(f"{out}/runs").count() == 1


def test_index_command(spark, tmp_path):
    (tmp_path / "company.idx").write_text("x\n---\nA|10-K|1|2021-03-01|e/0000000001-21-000001.txt\nA|10-K|1|2021-03-02|e/0000000001-21-000001.txt\nB|10-K|2|2021-04-01|e/0000000002-21-000001.txt\n")
    got = cli.main(["index", "--index", str(tmp_path / "company.idx"), "--out", str(tmp_path / "o"), "--filing", "10k", "--year", "2021", "--id", "1", "0000000002"], spark)
    assert [tuple(r) for r in got.collect()] == [(2021, 2, 2)]


def test_items_without_text_are_read_from_their_html(spark, tmp_path):
    rows = [("1", 2020, "10-K", "1", "text", "<p>html</p>", None), ("2", 2020, "10-K", "1", " ", "<p>from <b>html</b></p><script>x</script>", None), ("3", 2020, "10-K", "1", None, None, None), ("4", 2020, "10-K", "1", None, "<p>bad</p>", "error")]
    spark.createDataFrame(rows, "cik STRING, year INT, form STRING, item_id STRING, text_content STRING, html_content STRING, error STRING").write.parquet(str(tmp_path / "items"))
    args = cli.parser().parse_args(["vectors", "--out", str(tmp_path)])
    assert {r.firm_id: r.text for r in cli._items(spark, args).collect()} == {"1": "text", "2": "from html", "3": None}


def test_legacy_tickers(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("fiscal_year,cik,ticker\n")
    (tmp_path / "old.csv").write_text("fiscal_year,cik,ticker\n2020,1,ABC\n")
    for name in ("empty.csv", "none.csv"):
        assert files.ticker_map(spark, str(tmp_path / name), str(tmp_path / "old.csv")).first().ticker == "ABC"


def test_matrices_whose_ids_do_not_fit_are_refused(spark, tmp_path):
    (tmp_path / "1" / "2020").mkdir(parents=True)
    np.savez(tmp_path / "1" / "2020" / "0.npz", mat=np.ones((3, 2)), ids=np.array(["a", "b"]))
    with pytest.raises(Exception, match="2 ids for a matrix"):
        matrices.read_matrices(spark, str(tmp_path)).collect()


def test_json_artifacts(spark, tmp_path):
    folder = tmp_path / "0000000001" / "2022" / "10-K"
    folder.mkdir(parents=True)
    item = {"item_number": "1", "item_title": "t", "html_content": "<p>x</p>", "text_content": "x"}
    (folder / "0000000001_2022_10-K_item.json").write_text(json.dumps({"cik": "1", "year": "2022", "filing": "10-K", "source_file": "s", "toc_items": {"1": {"anchor": "a", "title": "t"}, "1 a": {}}, "items": {"1": item, "1 a": {"error": "e"}, "9": item}}))
    (folder / "0000000001_2022_10-K_str.json").write_text(json.dumps({"structures": {"1": [{"type": "heading", "layer": 1, "heading": "h", "body": "b", "children": [{"type": "heading", "layer": 2, "heading": "c", "body": None, "children": []}]}], "7": {"error": "e"}}}))
    (folder / "0000000001_2022_10-K_item_summ.json").write_text(json.dumps({"items": {"1": {"summary": "s", "target_words": 5}, "7": {"summary": " "}}}))
    root = str(tmp_path)
    assert sorted((r.firm_id, r.year, r.item_id, r.error) for r in files.item_files(spark, root, "10-K", [2022]).collect()) == [("0000000001", 2022, "1", None), ("0000000001", 2022, "1A", "e")]
    assert files.item_files(spark, root, "10-KA").count() == 0
    assert [(r.item_id, r.node_ord, r.parent_ord, r.heading) for r in files.structure_files(spark, root).collect()] == [("1", 0, -1, "h"), ("1", 1, 0, "c")]
    assert [(r.item_id, r.summary) for r in files.summary_files(spark, root).collect()] == [("1", "s")]


def test_ids_of_csv_stay_strings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("firm_id,year\n0000320193,2020\n")
    assert files.any_table(spark, str(tmp_path / "m.csv"), "firm_id STRING, year INT").first().firm_id == "0000320193"
    (tmp_path / "t.csv").write_text("﻿fiscal_year,cik,ticker\n2020,1,ABC\n")
    assert files.ticker_map(spark, str(tmp_path / "t.csv")).first().ticker == "ABC"


def test_incremental_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    sinks.write_new(df, path, ["k"])
    sinks.write_new(df.withColumn("v", F.lit("new")).unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    sinks.write_json(df, str(tmp_path / "j"), ["k"], "v", ["v"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_table(df, str(tmp_path / "x.csv"))
    assert "| k | v |" in sinks.markdown(df, "title")


def quarter(year, number):
    if year == 2022:
        raise OSError("closed")
    return "" if number == 4 else f"x\n---\nA|10-K|{number}|{year}-01-01|f.txt\n"


def test_quarterly_source(spark):
    spark.dataSource.register(remote.QuarterlyIndex)
    rows = spark.read.format("quarterly_index").option("years", "2020,2021").option("fetcher", "tests.test_pipeline:quarter").load()
    assert rows.count() == 6 and rows.rdd.getNumPartitions() == 1
    rows = spark.read.format("quarterly_index").option("years", "2021,2022").option("fetcher", "tests.test_pipeline:quarter").option("tasks", "3").load()
    assert rows.where("value IS NULL").select("error").distinct().first().error == "closed" and rows.count() == 7 and rows.rdd.getNumPartitions() == 3
    assert index_records.parse_index(rows).count() == 3


def test_fetch_retries_only_refusals(monkeypatch):
    import urllib.error

    codes, waits = [429, 429, 404], []

    def refuse(request, timeout):
        raise urllib.error.HTTPError("u", codes.pop(0), "m", {}, None)

    monkeypatch.setattr(remote.urllib.request, "urlopen", refuse)
    assert remote.fetch("http://x", "me", wait=waits.append) == "" and waits == [1.0, 1.0]
    codes[:] = [404]
    assert remote.fetch("http://x", "me", wait=waits.append, delay=0.1) == "" and waits[2:] == [0.1]
    codes[:] = [500]
    with pytest.raises(urllib.error.HTTPError):
        remote.fetch("http://x", "me", wait=waits.append)


def test_stream_ingest_is_idempotent(spark, tree, tmp_path):
    table = str(tmp_path / "items")
    for checkpoint in ("a", "a", "b"):  # a restart, then a lost checkpoint
        ingest.ingest_items(spark, str(tree), table, str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(table).count() == 18


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 10:00:00", "b")], "ts STRING, k STRING").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("partitions", [(), ("year",)])
def test_overwrite_keeps_what_the_run_does_not_cover(spark, tmp_path, partitions):
    path, schema = str(tmp_path / "t"), "firm STRING, year INT, form STRING, item STRING, v STRING"
    rows = [("1", 2021, "10-K", "1", "a"), ("1", 2021, "10-K", "7", "b"), ("1", 2021, "10-Q", "1", "c"), ("2", 2021, "10-K", "1", "d"), ("1", 2022, "10-K", "1", "e"), (None, 2021, "10-K", "1", "f")]
    sinks.write_new(spark.createDataFrame(rows, schema), path, ["firm", "year", "form", "item"], partitions)
    read = lambda: sorted(r.v for r in spark.read.parquet(path).collect())
    sinks.write_new(spark.createDataFrame([("1", 2021, "10-K", "1", "new"), (None, 2021, "10-K", "1", "none")], schema), path, ["firm", "year", "form", "item"], partitions, True)
    assert read() == ["b", "c", "d", "e", "new", "none"]
    sinks.write_new(spark.createDataFrame([("1", 2021, "10-K", "1", "whole")], schema), path, ["firm", "year", "form", "item"], partitions, True, ["firm", "year", "form"])
    assert read() == ["c", "d", "e", "none", "whole"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
