from pyspark.sql import functions as F

from peerlens import cli
from peerlens.operators import download as D
from peerlens.operators.index_records import STATUSES, status_report

PAGE = """<table class="tableFile"><tr><th>Seq</th></tr>
<tr><td>1</td><td>d</td><td><a href="/ix?doc=/Archives/{n}.htm">{n}.htm iXBRL</a></td><td>{kind}</td></tr>
<tr><td>2</td><td>d</td><td><a href="/x.htm">x.htm</a></td><td>EX</td></tr></table>"""
TAGS = '<ix:nonNumeric name="dei:DocumentFiscalYearFocus">{y}</ix:nonNumeric><ix:nonNumeric name="dei:TradingSymbol">abc</ix:nonNumeric><p>text</p>'


def get(url):
    """Pages of a small site."""
    number = url.rsplit("/", 1)[-1].removesuffix("-index.html").removesuffix(".htm")
    if "browse-edgar" in url:
        entry = "<entry><filing-date>{}</filing-date><accession-number>{}</accession-number></entry>"
        return entry.format("2021-05-01", "a-amended") + entry.format("2020-01-01", "a-2020") + entry.format("2021-04-01", "a-2021")
    if url.endswith("-index.html"):
        return "" if "none" in url else PAGE.format(n=number, kind="10-K/A" if "amended" in url else "10-K")
    return {"a-2021": TAGS.format(y=2021), "a-2019": TAGS.format(y=2019), "a-plain": "<p>no tags</p>"}.get(number, "")


def test_pages():
    assert D.main_document(PAGE.format(n="q", kind="10-K"), "B") == "B/Archives/q.htm"
    assert D.main_document("<p>nothing</p>") is None
    assert D.document_of_year(get, "0000000001", "10-K", 2021, "B") == "B/Archives/a-2021.htm"
    assert D.document_of_year(get, "0000000001", "10-K", 1999, "B") is None
    assert D.index_url("0000000012", "1-2-3", "B") == "B/Archives/edgar/data/12/123/1-2-3-index.html"


def test_download_is_incremental_and_reports(spark, tmp_path):
    records = spark.createDataFrame([("0000000001", a, "2021-01-01") for a in ("a-2021", "a-2019", "a-plain", "a-none")], "cik_padded STRING, accession_number STRING, date_filed STRING")
    table = str(tmp_path / "t")
    first = D.download(records, table, [2021], get, "10-K")
    assert {r.accession_number: r.status for r in first.collect()} == {"a-2021": "downloaded", "a-2019": "skipped_outside_target_fy", "a-plain": "missing_fiscal_metadata", "a-none": "failed_download"}
    again = D.download(records, table, [2021], get, "10-K")
    total = status_report(again).where("is_total").first()
    assert [total[s] for s in STATUSES] == [0, 1, 1, 1, 1]
    assert [(r.cik, r.year, r.ticker_symbols) for r in spark.read.parquet(table).select("cik", F.col("year").cast("int"), "ticker_symbols").collect()] == [("0000000001", 2021, ["ABC"])]


def test_forms_of_a_firm_and_year_are_apart(spark, tmp_path, monkeypatch):
    site = lambda url: TAGS.format(y=2021) if url.endswith(".htm") else PAGE.format(n=url.rsplit("/", 1)[-1].removesuffix("-index.html"), kind="10-K")
    monkeypatch.setattr(cli.download, "HttpGetter", lambda agent: site)
    rows = [("0000000001", "a-annual", "2021-03-01", "10-K"), ("0000000001", "a-quarter", "2021-05-01", "10-Q")]
    spark.createDataFrame(rows, "cik_padded STRING, accession_number STRING, date_filed STRING, form_type STRING").write.parquet(str(tmp_path / "records"))
    for form in ("10-K", "10q", "10-Q"):
        cli.main(["download", "--out", str(tmp_path), "--agent", "me", "--filing", form, "--year", "2021"], spark)
    got = spark.read.parquet(str(tmp_path / "filings")).select("form", "accession_number").collect()
    assert sorted(map(tuple, got)) == [("10-K", "a-annual"), ("10-Q", "a-quarter")]
