"""Readers of the engine's artifacts: index files, filing HTML, item, structure and summary JSON, tables, tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "STRUCT<item_number STRING, item_title STRING, html_content STRING, text_content STRING, error STRING>"
ITEM_JSON = f"cik STRING, year STRING, filing STRING, source_file STRING, toc_items MAP<STRING, STRUCT<anchor STRING, title STRING>>, items MAP<STRING, {_ITEM}>"
SUMMARY_JSON = "firm_id STRING, year INT, filing_type STRING, source_path STRING, items MAP<STRING, STRUCT<summary STRING, target_words INT, llm STRING, source_path STRING, previous_year_available BOOLEAN>>"
STRUCTURE_JSON = "cik STRING, year STRING, filing STRING, source_file STRING, structures VARIANT"
META_JSON = "source STRING, cik STRING, fiscal_year INT, filing_type STRING, folder_form STRING, filing_date STRING, period_of_report STRING, accession_number STRING, source_file_name STRING, tags_found MAP<STRING, STRING>, ticker_symbols ARRAY<STRING>"
METADATA = "firm_id STRING, year INT, sic STRING, naics STRING, gics STRING, market_cap DOUBLE, revenue DOUBLE"
ANALYSTS = "focal_firm STRING, peer_firm STRING, year INT"
TICKERS = "fiscal_year STRING, cik STRING, ticker STRING, source STRING, updated_at STRING"


def path_part(name: str, path: Column | None = None) -> Column:
    """cik, year or form of an artifact's path <root>/<cik>/<year>/<form>/<file>; if the folders don't say it, of a file
    name <cik>_<year>_<form>."""
    path = F.col("_metadata.file_path") if path is None else path
    i = ("cik", "year", "form").index(name) + 1
    folders, file = r"/([0-9]{1,10})/([0-9]{4})/([^/]+)/[^/]+\z", r"/([0-9]{10})_([0-9]{4})_([^/_.]+)[^/]*\z"
    found = F.coalesce(*(F.nullif(F.regexp_extract(path, p, i), F.lit("")) for p in (folders, file)))
    return found.cast("int") if name == "year" else F.lpad(found, 10, "0") if name == "cik" else found


def _located(df: DataFrame, form: str | None, years: list[int] | None) -> DataFrame:
    """The path columns, and only exactly this form and these years."""
    rows = df.withColumn("source_path", F.col("_metadata.file_path"))
    rows = rows.select("*", *(path_part(n, F.col("source_path")).alias(f"path_{n}") for n in ("cik", "year", "form")))
    if form:
        rows = rows.where(F.col("path_form") == form)
    return rows.where(F.col("path_year").isin([int(y) for y in years])) if years else rows


def index_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value: whole company.idx files, for operators.index_records.parse_index."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def filings(spark: SparkSession, root: str, form: str | None = None, years: list[int] | None = None, ciks: list[str] | None = None) -> DataFrame:
    """cik, year, form, source_path, html of <root>/<cik>/<year>/<form>/*.htm and *.html. Bytes that aren't UTF-8 are
    replaced. The filters are applied to paths before any file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{htm,html}").load(root)
    rows = rows.select(F.col("path").alias("source_path"), "content").select(*(path_part(n, F.col("source_path")).alias(n) for n in ("cik", "year", "form")), "source_path", "content")
    if form:
        rows = rows.where(F.col("form") == form)
    if years:
        rows = rows.where(F.col("year").isin([int(y) for y in years]))
    if ciks:
        rows = rows.where(F.col("cik").isin([c.zfill(10) for c in ciks]))

    def decoded(batches):
        import pyarrow as pa

        for b in batches:
            texts = [None if v is None else v.decode("utf-8", "replace") for v in b.column("content").to_pylist()]
            yield b.drop_columns(["content"]).append_column("html", pa.array(texts, pa.string()))

    return rows.mapInArrow(decoded, "cik STRING, year INT, form STRING, source_path STRING, html STRING")


def _json(spark: SparkSession, root: str, suffix: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}.json").json(root)


def item_files(spark: SparkSession, root: str, form: str | None = None, years: list[int] | None = None) -> DataFrame:
    """firm_id, year, form, item_id, item_title, html_content, text_content, error, source_path of *_item.json: items
    that the table of contents lists, with normalised ids."""
    from peerlens.functions.text import item_id

    rows = _located(_json(spark, root, "_item", ITEM_JSON), form, years)
    rows = rows.select(F.col("path_cik").alias("firm_id"), F.col("path_year").alias("year"), F.col("path_form").alias("form"), "source_path", "toc_items", F.explode("items").alias("key", "item"))
    rows = rows.where(F.array_contains(F.map_keys("toc_items"), F.col("key")))
    return rows.select("firm_id", "year", "form", item_id(F.col("key")).alias("item_id"), "item.item_title", "item.html_content", "item.text_content", "item.error", "source_path")


def structure_files(spark: SparkSession, root: str, form: str | None = None, years: list[int] | None = None) -> DataFrame:
    """firm_id, year, form, item_id, node_ord, parent_ord, path, type, layer, heading, body, source_path of *_str.json."""
    import json

    import pyarrow as pa

    from peerlens.html.structure import flat

    rows = _located(_json(spark, root, "_str", STRUCTURE_JSON), form, years)
    rows = rows.select(F.col("path_cik").alias("firm_id"), F.col("path_year").alias("year"), F.col("path_form").alias("form"), "source_path", F.to_json("structures").alias("json"))

    def run(batches):
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("node_ord", pa.int32()), ("parent_ord", pa.int32()), ("path", pa.list_(pa.int32())), ("type", pa.string()), ("layer", pa.int32()), ("heading", pa.string()), ("body", pa.string())]))
        for b in batches:
            made = []
            for text in b.column("json").to_pylist():
                out = []
                for item, tree in (json.loads(text) if text else {}).items():
                    if isinstance(tree, list):
                        out += [{"item_id": "".join(item.upper().split()), "node_ord": i, "parent_ord": n.parent, "path": n.path, "type": n.kind, "layer": n.layer, "heading": n.heading, "body": n.body} for i, n in enumerate(flat(tree))]
                made.append(out)
            yield b.drop_columns(["json"]).append_column("nodes", pa.array(made, kind))

    nodes = "ARRAY<STRUCT<item_id STRING, node_ord INT, parent_ord INT, path ARRAY<INT>, type STRING, layer INT, heading STRING, body STRING>>"
    return rows.mapInArrow(run, f"firm_id STRING, year INT, form STRING, source_path STRING, nodes {nodes}").select("firm_id", "year", "form", "source_path", F.inline("nodes"))


def summary_files(spark: SparkSession, root: str, form: str | None = None, years: list[int] | None = None) -> DataFrame:
    """firm_id, year, form, item_id, summary, target_words, llm, previous_year_available, source_path of
    *_item_summ.json, without empty summaries."""
    from peerlens.functions.text import item_id

    rows = _located(_json(spark, root, "_item_summ", SUMMARY_JSON), form, years)
    rows = rows.select(F.col("path_cik").alias("firm_id"), F.col("path_year").alias("year"), F.col("path_form").alias("form"), "source_path", F.explode("items").alias("key", "item"))
    return rows.where("trim(item.summary) <> ''").select("firm_id", "year", "form", item_id(F.col("key")).alias("item_id"), "item.summary", "item.target_words", "item.llm", "item.previous_year_available", "source_path")


def any_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV or Parquet table by its extension. CSV columns are read as strings and cast as the schema says, so ids keep
    their zeros; columns that the file lacks are left out, others that it has come as strings."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    kinds = dict(f.strip().split(" ", 1) for f in schema.split(","))
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in rows.columns))


def ticker_map(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """fiscal_year, cik, ticker, source, updated_at; a byte-order mark is tolerated. If the map is missing or has no rows,
    the legacy one is read."""
    from peerlens.sources.sinks import exists

    if legacy and (not exists(spark, path) or not spark.read.option("header", "true").csv(path).limit(1).count()):
        path = legacy
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    names = [f.split()[0] for f in TICKERS.split(", ")]
    return rows.select(*(F.col(n).cast("string") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))
