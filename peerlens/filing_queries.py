"""Registered queries over filings that they compose themselves from the rows of filing_item, so that SQL knows what must
come out: a table of contents with links, a section for each item, and an end marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.config import FORM_ITEMS
from peerlens.functions import text as X
from peerlens.operators import download, filings, index_records, models
from peerlens.plans import new_folder, stage
from peerlens.registry import query
from peerlens.sources import files, remote, sinks, table
from peerlens.streaming import ingest

_LEAD, _SUB = "several statements about material matters were made here within this annual report", "Overview Of Important Matters"

_SCOPE = ", ".join(f"('{form}', '{i}')" for form, items in FORM_ITEMS.items() for i in items)
_PARTS = rf"""
r AS (SELECT row_id, lpad(cik, 10, '0') AS cik, year, filing, regexp_extract(upper(item_number), '([0-9]{{1,2}}[A-C]?)', 1) AS item_id, item_title, text_content FROM filing_item WHERE text_content IS NOT NULL AND item_number IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY cik, year, filing, item_id ORDER BY row_id DESC) AS k FROM r WHERE item_id <> ''),
p AS (SELECT cik, year, filing, item_id, row_id, CAST(regexp_extract(item_id, '([0-9]+)', 1) AS INT) AS number, coalesce(nullif(array_to_string(regexp_extract_all(item_title, '[A-Za-z]{{3,}}'), ' '), ''), 'Untitled Matters') AS title, replace(concat('{_LEAD} ', array_to_string(regexp_extract_all(lower(text_content), '[a-z]{{4,}}'), ' '), ' ending.'), '  ', ' ') AS body FROM k WHERE k = 1),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY cik, year, filing ORDER BY number, item_id) - 1 AS INT) AS ord, count(*) OVER (PARTITION BY cik, year, filing) AS items FROM p),
toc AS (SELECT *, 'i' || ord AS anchor, 'Item ' || item_id || '. ' || title AS toc_title FROM o WHERE items >= 2),
s AS (SELECT * FROM toc WHERE filing NOT IN (SELECT form FROM (VALUES {_SCOPE}) v(form, item)) OR EXISTS (SELECT 1 FROM (VALUES {_SCOPE}) v(form, item) WHERE form = filing AND item = item_id))"""


def _letters(c: Column, pattern: str) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), " ")


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """cik, year, form, html: a filing of the latest text of each of its items."""
    item = F.regexp_extract(F.upper("item_number"), "([0-9]{1,2}[A-C]?)", 1)
    rows = table(spark, d, "filing_item").where("text_content IS NOT NULL AND item_number IS NOT NULL")
    rows = rows.select("row_id", F.lpad("cik", 10, "0").alias("cik"), "year", F.col("filing").alias("form"), item.alias("item"), "item_title", "text_content").where("item <> ''")
    keys = ["cik", "year", "form"]
    last = Window.partitionBy(*keys, "item").orderBy(F.desc("row_id"))
    rows = rows.withColumn("k", F.row_number().over(last)).where("k = 1")
    title = F.coalesce(F.nullif(_letters(F.col("item_title"), "[A-Za-z]{3,}"), F.lit("")), F.lit("Untitled Matters"))
    body = F.concat(F.lit(f"{_LEAD} "), _letters(F.lower("text_content"), "[a-z]{4,}"), F.lit(" ending."))
    part = F.struct(F.regexp_extract("item", "([0-9]+)", 1).cast("int").alias("number"), F.col("item"), title.alias("title"), body.alias("body"))
    parts = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    line = lambda p, i: F.concat(F.lit('<tr><td><a href="#i'), i.cast("string"), F.lit('">Item '), p["item"], F.lit(".</a> </td><td>"), p["title"], F.lit(" </td><td>"), (i + 3).cast("string"), F.lit("</td></tr>"))
    section = lambda p, i: F.concat(F.lit('<div id="i'), i.cast("string"), F.lit('"><p><b>ITEM '), p["item"], F.lit(". "), p["title"], F.lit(f"</b></p><p><b>{_SUB}</b></p><p>"), p["body"], F.lit("</p></div>"))
    joined = lambda f: F.array_join(F.transform("parts", f), "")
    html = F.concat(F.lit("<html><body><p>TABLE OF CONTENTS</p><table>"), joined(line), F.lit("</table>"), joined(section), F.lit('<p id="signatures">SIGNATURES</p><p>signed</p></body></html>'))
    return parts.select(*keys, html.alias("html"))


@query(f"WITH {_PARTS} SELECT cik, year, filing AS form, ord, item_id, anchor, toc_title AS title FROM toc")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return filings.toc_entries(_filings(spark, d)).select("cik", "year", "form", "ord", "item_id", "anchor", "title")


@query(f"WITH {_PARTS} SELECT cik, year, filing AS form, ord, item_id, toc_title AS item_title, anchor, md5('ITEM ' || item_id || '. ' || title || ' {_SUB} ' || body) AS text, CAST(NULL AS VARCHAR) AS error, false AS out_of_order FROM s")
def item_extract(spark: SparkSession, d: str) -> DataFrame:
    items = filings.extract_items(_filings(spark, d))
    return items.select("cik", "year", "form", "ord", "item_id", "item_title", "anchor", F.md5("text_content").alias("text"), "error", F.coalesce("out_of_order", F.lit(False)).alias("out_of_order"))


@query(f"WITH {_PARTS} SELECT cik, year, filing AS form, item_id, n.node_ord, n.node_ord - 1 AS parent_ord, 'heading' AS type, n.node_ord + 1 AS layer, CASE n.node_ord WHEN 0 THEN toc_title ELSE '{_SUB}' END AS heading, CASE n.node_ord WHEN 1 THEN md5(body) END AS body FROM s, (VALUES (0), (1)) n(node_ord)")
def item_structure(spark: SparkSession, d: str) -> DataFrame:
    nodes = filings.structure_nodes(filings.extract_items(_filings(spark, d)).drop("text_content"))
    return nodes.select("cik", "year", "form", "item_id", "node_ord", "parent_ord", "type", "layer", "heading", F.md5("body").alias("body"))


@query(f"WITH {_PARTS} SELECT cik, year, filing AS form, item_id, toc_title || chr(10) || chr(10) || '{_SUB}' AS text FROM s")
def heading_texts(spark: SparkSession, d: str) -> DataFrame:
    nodes = filings.structure_nodes(filings.extract_items(_filings(spark, d)).drop("text_content"))
    return filings.field_text(nodes, ["cik", "year", "form", "item_id"], "heading")


@query(f"WITH {_PARTS} SELECT p.row_id, md5(concat('ITEM ', item_id, '. ', left(body, length(body) - 1), ' ', left(body, length(body) - 1), '')) AS tidied FROM p")
def tidied_items(spark: SparkSession, d: str) -> DataFrame:
    """Two pages of each item with headers and footers around them."""
    item = F.regexp_extract(F.upper("item_number"), "([0-9]{1,2}[A-C]?)", 1)
    rows = table(spark, d, "filing_item").where("text_content IS NOT NULL AND item_number IS NOT NULL")
    rows = rows.select("row_id", F.lpad("cik", 10, "0").alias("cik"), "year", "filing", item.alias("item"), "text_content").where("item <> ''")
    last = Window.partitionBy("cik", "year", "filing", "item").orderBy(F.desc("row_id"))
    rows = rows.withColumn("k", F.row_number().over(last)).where("k = 1")
    body = F.concat(F.lit(f"{_LEAD} "), _letters(F.lower("text_content"), "[a-z]{4,}"), F.lit(" ending"))
    pages = F.concat(F.lit("7 ITEM "), F.col("item"), F.lit(". "), body, F.lit(" 12 PAGE_BREAK_MARKER 10-K Page "), body, F.lit(" Form 10-K | 13"))
    return filings.tidied(rows.select("row_id", "item", pages.alias("text")), "text", "item").select("row_id", F.md5("tidied").alias("tidied"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY file_name, accession_number, company_name, date_filed) AS n, * FROM index_record)
SELECT coalesce(trim(company_name), '') AS company_name, form_type, trim(cik) AS cik, lpad(trim(cik), 10, '0') AS cik_padded, coalesce(trim(date_filed), '') AS date_filed, file_name, regexp_extract(file_name, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1) AS accession_number FROM index_record
WHERE form_type IS NOT NULL AND cik IS NOT NULL AND file_name IS NOT NULL""")
def parsed_index(spark: SparkSession, d: str) -> DataFrame:
    """Index files of both layouts, one for each ending of the firm's id."""
    text = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit(""))
    rows = table(spark, d, "index_record").where("form_type IS NOT NULL AND cik IS NOT NULL AND file_name IS NOT NULL")
    piped = F.concat_ws("|", *(text(c) for c in ("company_name", "form_type", "cik", "date_filed", "file_name")))
    fixed = F.concat(F.rpad(text("company_name"), 62, " "), *(F.rpad(text(c), 12, " ") for c in ("form_type", "cik", "date_filed")), text("file_name"))
    ending = F.right(F.btrim("cik"), F.lit(1)).cast("int")
    lines = rows.select(ending.alias("ending"), F.when(ending % 2 == 0, piped).otherwise(fixed).alias("line"))
    files = lines.groupBy(F.concat(F.lit("company"), F.col("ending").cast("string"), F.lit(".idx")).alias("path")).agg(F.concat(F.lit("Description: index\n\nCompany|Form\n-----------\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\n\n")).alias("value"))
    return index_records.parse_index(files).drop("path", "line_no")


@query("WITH t AS (SELECT row_id, html_content, regexp_replace(regexp_replace(html_content, '<[^>]*>', ' ', 'g'), '[\\t\\n\\x0B\\f\\r \\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g') AS t FROM filing_item WHERE html_content IS NOT NULL) SELECT row_id, trim(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS text FROM t")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filing_item").where("html_content IS NOT NULL").select("row_id", "html_content")
    return filings.html_texts(rows, "html_content", "visible").select("row_id", X.collapse(F.col("text")).alias("text"))


@query(f"WITH {_PARTS} SELECT cik, year, filing AS form, item_id, md5(body) AS text FROM s")
def body_texts(spark: SparkSession, d: str) -> DataFrame:
    nodes = filings.structure_nodes(filings.extract_items(_filings(spark, d)).drop("text_content"))
    return filings.field_text(nodes, ["cik", "year", "form", "item_id"], "body").withColumn("text", F.md5("text"))


# --- files, fetches and streams ---


@query(f"WITH {_PARTS} SELECT cik, year, filing AS form, ord, item_id, anchor, toc_title AS title FROM toc")
def filing_files(spark: SparkSession, d: str) -> DataFrame:
    """Filings written as files of their own and read back by their paths."""
    folder = new_folder(spark, "filings")
    sinks.write_files(_filings(spark, d), folder, sinks.artifact_path(".htm"), F.col("html"))
    found = files.filings(spark, folder).withColumn("year", F.col("year").cast("string"))
    return filings.toc_entries(found).select("cik", "year", "form", "ord", "item_id", "anchor", "title")


@query(f"WITH {_PARTS} SELECT cik AS firm_id, CAST(year AS INT) AS year, filing AS form, item_id, toc_title AS item_title, md5('ITEM ' || item_id || '. ' || title || ' {_SUB} ' || body) AS text, 'composed' AS source FROM s WHERE filing = '10-K'")
def item_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Items of annual reports written as JSON artifacts and read back."""
    folder = new_folder(spark, "items")
    items = filings.extract_items(_filings(spark, d).withColumn("source_path", F.lit("composed")))
    sinks.write_items(items, folder)
    found = files.item_files(spark, folder, "10-K")
    return found.select("firm_id", "year", "form", "item_id", "item_title", F.md5("text_content").alias("text"), F.lit("composed").alias("source"))


@query(f"WITH {_PARTS} SELECT cik AS firm_id, CAST(year AS INT) AS year, filing AS form, item_id, n.node_ord, n.node_ord - 1 AS parent_ord, 'heading' AS type, n.node_ord + 1 AS layer, CASE n.node_ord WHEN 0 THEN toc_title ELSE '{_SUB}' END AS heading, CASE n.node_ord WHEN 1 THEN md5(body) END AS body FROM s, (VALUES (0), (1)) n(node_ord)")
def structure_artifacts(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "structures")
    sinks.write_structures(filings.structure_nodes(filings.extract_items(_filings(spark, d)).drop("text_content")), folder)
    found = files.structure_files(spark, folder)
    return found.select("firm_id", "year", "form", "item_id", "node_ord", "parent_ord", "type", "layer", "heading", F.md5("body").alias("body"))


@query(f"WITH {_PARTS} SELECT cik AS firm_id, CAST(year AS INT) AS year, filing AS form, item_id, array_to_string((string_split('ITEM ' || item_id || '. ' || title || ' {_SUB} ' || body, ' '))[:120], ' ') AS summary, 1000 AS target_words, 'llama3.2:3b' AS llm FROM s")
def summary_artifacts(spark: SparkSession, d: str) -> DataFrame:
    folder, keys = new_folder(spark, "summaries"), ["firm_id", "year", "form", "item_id"]
    items = filings.extract_items(_filings(spark, d)).select(F.col("cik").alias("firm_id"), F.col("year").cast("int").alias("year"), "form", "item_id", F.col("item_id").alias("_i"), "text_content")
    done = models.summarize(items, keys, "_i", "text_content", models.lead_words(), "llama3.2:3b").withColumn("previous_year_available", F.lit(False))
    sinks.write_summaries(done, folder)
    return files.summary_files(spark, folder).select(*keys, "summary", "target_words", "llm")


@query("""WITH r AS (SELECT file_name, accession_number, CAST(right(cik, 1) AS INT) AS e, CAST(right(cik, 2) AS INT) + 1980 AS fy FROM index_record WHERE cik IS NOT NULL)
SELECT file_name, accession_number, CASE WHEN e < 8 THEN fy END AS fiscal_year, CASE WHEN e < 8 AND e <> 3 THEN 'December 31, ' || fy END AS period_of_report, CASE WHEN e % 2 = 0 THEN 'AB' || e || ',XY' ELSE '' END AS ticker_symbols FROM r""")
def ixbrl_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of composed filings, of which some lack the year, the period or the symbols."""
    rows = table(spark, d, "index_record").where("cik IS NOT NULL")
    ending, year = F.right("cik", F.lit(1)).cast("int"), (F.right("cik", F.lit(2)).cast("int") + 1980).cast("string")
    tag = lambda name, value: F.concat(F.lit(f'<ix:nonNumeric contextRef="c" name="dei:{name}" id="x"><span>'), value, F.lit("</span></ix:nonNumeric>\n"))
    focus = F.when(ending.isin(0, 1, 2, 3), tag("DocumentFiscalYearFocus", year)).otherwise("")
    period = F.when((ending < 8) & (ending != 3), tag("DocumentPeriodEndDate", F.concat(F.lit("December  31,</span> <b>"), year, F.lit("</b><span>")))).otherwise("")
    symbol = F.concat(F.lit("ab"), ending.cast("string"))
    symbols = F.when(ending % 2 == 0, F.concat(tag("TradingSymbol", symbol), tag("TradingSymbol", F.lit(" xy ")), tag("TradingSymbol", F.upper(symbol)))).otherwise("")
    tags = X.ixbrl_tags(F.concat(F.lit("<html>"), focus, period, symbols, F.lit("</html>")))
    return rows.select("file_name", "accession_number", tags.alias("t")).select("file_name", "accession_number", "t.fiscal_year", "t.period_of_report", F.array_join("t.ticker_symbols", ",").alias("ticker_symbols"))


def quarter(year: int, number: int) -> str:
    """The index file of a quarter, by rule: as many firms as its number, none in the first of odd years; 2022 is closed."""
    if year == 2022:
        raise OSError("closed")
    if year % 2 and number == 1:
        return ""
    rows = [f"Firm {i}|10-{'KQ'[i % 2]}|{year * 10 + i}|{year}-0{number}-1{i}|edgar/{year * 10 + i:010}-{year % 100:02}-{number:06}.txt" for i in range(number)]
    return "\n".join(["Company Name|Form Type|CIK|Date Filed|File Name", "-" * 80, *rows, ""])


@query("""WITH y AS (SELECT unnest([2019, 2020, 2021]) AS y), q AS (SELECT unnest(range(1, 5)) AS q), r AS (SELECT y, q, unnest(range(0, q)) AS i FROM y, q WHERE NOT (y % 2 = 1 AND q = 1))
SELECT y || '/QTR' || q || '/company.idx' AS path, 'Firm ' || i AS company_name, CASE i % 2 WHEN 0 THEN '10-K' ELSE '10-Q' END AS form_type, lpad(CAST(y * 10 + i AS VARCHAR), 10, '0') AS cik_padded, y || '-0' || q || '-1' || i AS date_filed, lpad(CAST(y * 10 + i AS VARCHAR), 10, '0') || '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(q AS VARCHAR), 6, '0') AS accession_number, CAST(NULL AS VARCHAR) AS error FROM r
UNION ALL SELECT '2022/QTR' || q || '/company.idx', NULL, NULL, NULL, NULL, NULL, 'closed' FROM q""")
def fetched_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Records of quarters from a fetcher, with the quarters that failed."""
    spark.dataSource.register(remote.QuarterlyIndex)
    got = stage(spark.read.format("quarterly_index").option("years", "2019,2020,2021,2022").option("fetcher", "peerlens.filing_queries:quarter").option("tasks", "4").load(), "quarters")
    none = [F.lit(None).cast("string").alias(c) for c in ("company_name", "form_type", "cik_padded", "date_filed", "accession_number")]
    records = index_records.parse_index(got).select("path", "company_name", "form_type", "cik_padded", "date_filed", "accession_number", F.lit(None).cast("string").alias("error"))
    return records.unionByName(got.where("error IS NOT NULL").select("path", *none, "error"))


def site(url: str) -> str:
    """Pages of filings, by rule: of the last digit of the accession number 9 there is no page, 8 has no year, the others
    end in the fiscal year 2015 + digit."""
    number = url.rsplit("/", 1)[-1].removesuffix("-index.html").removesuffix(".htm")
    digit = int(number[-1]) if number[-1:].isdigit() else 9
    if digit == 9:
        return ""
    if url.endswith("-index.html"):
        return f'<table class="tableFile"><tr><th>Seq</th></tr><tr><td>1</td><td>d</td><td><a href="/ix?doc=/Archives/{number}.htm">{number}.htm</a></td><td>10-K</td></tr></table>'
    return "<p>plain</p>" if digit == 8 else f'<ix:nonNumeric name="dei:DocumentFiscalYearFocus">{2015 + digit}</ix:nonNumeric>'


@query("""WITH r AS (SELECT DISTINCT cik_padded, accession_number, CAST(right(accession_number, 1) AS INT) AS e FROM index_record WHERE trim(accession_number) <> '' AND cik_padded IS NOT NULL)
SELECT cik_padded, accession_number, CASE WHEN e < 8 THEN 2015 + e END AS fiscal_year, CASE WHEN e = 9 THEN 'failed_download' WHEN e = 8 THEN 'missing_fiscal_metadata' WHEN e IN (3, 4) THEN 'downloaded' ELSE 'skipped_outside_target_fy' END AS status FROM r""")
def downloads(spark: SparkSession, d: str) -> DataFrame:
    """Filings fetched from a site that follows a rule, of which two fiscal years are kept."""
    records = table(spark, d, "index_record").where("trim(accession_number) <> '' AND cik_padded IS NOT NULL").select("cik_padded", "accession_number").distinct().withColumn("date_filed", F.lit("2020-01-01"))
    return download.download(records, new_folder(spark, "downloads"), [2018, 2019], site, "10-K", tasks=4).select("cik_padded", "accession_number", "fiscal_year", "status")


@query("SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each hour and type, counted by a stream over files and added up by day."""
    folder = new_folder(spark, "stream")
    source = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    counts = ingest.windowed_counts(stream, "ts", "event_type", "1 hour", "0 seconds")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(F.to_date("window_start").cast("string").alias("day"), "event_type").agg(F.sum("n").alias("n"))


@query("SELECT form_type, CAST(count(DISTINCT date_filed[:4]) AS INT) AS years, CASE form_type WHEN '10-K' THEN 4500 WHEN '10-Q' THEN 13500 ELSE 5000 END * CAST(count(DISTINCT date_filed[:4]) AS INT) AS filings, 4 * CAST(count(DISTINCT date_filed[:4]) AS INT) AS quarters FROM index_record WHERE form_type IS NOT NULL GROUP BY form_type")
def filing_estimates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "index_record").where("form_type IS NOT NULL").groupBy("form_type").agg(F.count_distinct(F.left("date_filed", F.lit(4))).cast("int").alias("years"))
    return rows.select("form_type", "years", *index_records.estimates(F.col("form_type"), F.col("years")))
