"""Filings by accession number: from index pages to documents, tags, status and tables. The getter of pages is injected;
one call a page, at most as many at once as there are tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions import text as X
from peerlens.html.dom import Node, parse
from peerlens.operators.index_records import download_status
from peerlens.plans import stage
from peerlens.sources.remote import DELAY, fetch
from peerlens.sources.sinks import exists, write_new

BASE = "https://www.sec.gov"
#: A URL to its text; empty for a page that isn't there.
Getter = Callable[[str], str]


@dataclass
class HttpGetter:
    """Pages over HTTP with a user agent, `delay` seconds before each; refusals for too many requests are tried again.
    Tasks at work at once divide the public limit of ten requests a second: give each so many tenths as there are tasks."""

    agent: str
    delay: float = DELAY

    def __call__(self, url: str) -> str:
        return fetch(url, self.agent, delay=self.delay)


def index_url(cik: str, accession: str, base: str = BASE) -> str:
    """The index page of a filing."""
    return f"{base}/Archives/edgar/data/{cik.lstrip('0') or '0'}/{accession.replace('-', '')}/{accession}-index.html"


def _document_rows(page: str) -> list[tuple[str, str, str, Node]]:
    """sequence, file name, type and file cell of the first table of documents."""
    tables = list(parse(page).find_all("table"))
    classes = lambda t: t.attrs.get("class", "").split()
    found = next((t for name in ("tableFile", "tableFile2") for t in tables if name in classes(t)), None)
    rows = []
    for tr in list(found.find_all("tr"))[1:] if found else []:
        cells = list(tr.find_all("td"))
        if len(cells) >= 4:
            rows.append((cells[0].text().strip(), cells[2].text().strip(), cells[3].text().strip(), cells[2]))
    return rows


def main_document(page: str, base: str = BASE) -> str | None:
    """The URL of the document with sequence 1 on an index page, if it is HTML; links to the inline viewer are
    resolved to the document itself."""
    for sequence, name, _, cell in _document_rows(page):
        link = cell.find("a")
        if sequence == "1" and "htm" in name and link and link.attrs.get("href"):
            return base + link.attrs["href"].rpartition("/ix?doc=")[2]
    return None


def is_amendment(page: str) -> bool:
    return any("/A" in kind for _, _, kind, _ in _document_rows(page))


def feed_accessions(feed: str, year: int) -> list[str]:
    """Accession numbers of a company's feed that were filed in a year, in the feed's order."""
    out = []
    for entry in re.findall(r"<entry\b.*?</entry>", feed, re.DOTALL | re.IGNORECASE):
        field = lambda n: (re.search(rf"<{n}[^>]*>\s*(.*?)\s*</{n}>", entry, re.DOTALL | re.IGNORECASE) or ["", ""])[1]  # noqa: E731, B023
        if field("filing-date").startswith(str(year)) and (number := field("accession-number")):
            out.append(number)
    return out


def document_of_year(get: Getter, cik: str, form: str, year: int, base: str = BASE) -> str | None:
    """The main document of a company's first filing of a form in a year that isn't an amendment."""
    feed = get(f"{base}/cgi-bin/browse-edgar?action=getcompany&CIK={cik}&type={form}&owner=exclude&output=atom&count=100")
    for number in feed_accessions(feed, year):
        page = get(index_url(cik, number, base))
        if page and not is_amendment(page) and (url := main_document(page, base)):
            return url
    return None


def document(get: Getter, cik: str, accession: str, base: str = BASE) -> tuple[str, str, str]:
    """URL, extension and HTML of a filing's main document; LookupError if there is none."""
    url = main_document(get(index_url(cik, accession, base)), base)
    html = get(url) if url else ""
    if not html:
        raise LookupError(f"no document for accession {accession}")
    return url, "htm" if url.endswith(".htm") else "html", html


def fetch_documents(records: DataFrame, get: Getter, base: str = BASE, tasks: int = 1) -> DataFrame:
    """records (cik_padded, accession_number, ...) with url, extension, html and error, fetched by so many tasks. Stage
    the result: what isn't staged is fetched again whenever it is used."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    got = (*document(get, row.column("cik_padded")[0].as_py(), row.column("accession_number")[0].as_py(), base), None)
                except Exception as e:  # noqa: BLE001 - a failed filing is a status, not a failed run
                    got = (None, None, None, str(e))
                for name, value in zip(("url", "extension", "html", "error"), got):
                    row = row.append_column(name, pa.array([value], pa.string()))
                yield row

    return records.repartition(tasks).mapInArrow(run, f"{fields}, url STRING, extension STRING, html STRING, error STRING")


def download(records: DataFrame, table: str, targets: Sequence[int], get: Getter, form: str, overwrite: bool = False, base: str = BASE, tasks: int = 1) -> DataFrame:
    """Fetches filings, reads their tags and appends new ones of the target years to the table, new by firm, year and form: cik, year, form,
    source_path, filing_date, period_of_report, accession_number, ticker_symbols, html. Returns a row for each record
    with fiscal_year and status."""
    spark = records.sparkSession
    got = stage(fetch_documents(records.select("cik_padded", "accession_number", "date_filed"), get, base, tasks), "fetched")
    tagged = got.withColumn("tags", X.ixbrl_tags(F.col("html"))).select("*", "tags.*").drop("tags")
    have = None
    if exists(spark, table):
        have = spark.read.parquet(table).where(F.col("form") == form).select(F.col("cik").alias("cik_padded"), F.col("year").cast("int").alias("fiscal_year"), F.lit(True).alias("_have")).distinct()
    marked = tagged.join(have, ["cik_padded", "fiscal_year"], "left") if have is not None and not overwrite else tagged.withColumn("_have", F.lit(None).cast("boolean"))
    done = stage(download_status(marked, targets, F.coalesce("_have", F.lit(False)), F.col("error").isNotNull()).drop("_have"), "downloaded")
    new = done.where("status = 'downloaded'").select(F.col("cik_padded").alias("cik"), F.col("fiscal_year").alias("year"), F.lit(form).alias("form"), F.col("url").alias("source_path"), F.col("date_filed").alias("filing_date"), "period_of_report", "accession_number", "ticker_symbols", "html")
    write_new(new, table, ["cik", "year", "form"], ("year",), overwrite)
    return done.select("cik_padded", "accession_number", "fiscal_year", "ticker_symbols", "status", "error")
