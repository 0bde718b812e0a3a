"""Commands: index, download, extract, summarize, vectors, peers, evaluate. Each reads files, runs one plan and writes tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens import config
from peerlens.functions import text as X
from peerlens.operators import chunks, download, evaluate, filings, index_records, models, peers, vectors
from peerlens.plans import release, stage
from peerlens.sources import files, matrices, remote, sinks


def _index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    form = config.FILING_CODES.get(a.filing.lower(), (a.filing, a.filing))[0]
    if a.fetch:
        spark.dataSource.register(remote.QuarterlyIndex)
        source = spark.read.format("quarterly_index").option("years", ",".join(map(str, a.fetch))).option("base", a.base).option("agent", a.agent or "")
        index = stage(source.load(), "quarters")
        for r in index.where("error IS NOT NULL").select("path", "error").collect():
            print(f"{r.path}: {r.error}")
    else:
        index = files.index_files(spark, *a.index)
    records = index_records.parse_index(index, form)
    if a.tickers:
        wanted = index_records.resolve_ids(spark.createDataFrame([(t,) for t in a.id], "id STRING"), "id", files.ticker_map(spark, a.tickers, a.legacy_tickers)) if a.id else None
    else:
        wanted = spark.createDataFrame([(t,) for t in a.id], "id STRING").withColumn("cik", X.cik(F.col("id"))) if a.id else None
    if wanted is not None:
        records = index_records.of_firms(records, wanted)
    records = index_records.dedupe_accessions(records, [F.desc("path"), F.desc("line_no")])
    if not a.list_only:
        sinks.write_new(records, f"{a.out}/records", ["accession_number"])
    return index_records.fiscal_counts(records, a.year, a.lookahead)


def _download(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    form, folder = config.FILING_CODES.get(a.filing.lower(), (a.filing, a.filing))
    records = spark.read.parquet(f"{a.out}/records").where(F.col("form_type") == form)
    wanted = index_records.in_fiscal_windows(records, a.year, a.lookahead).dropDuplicates(["accession_number"])
    done = stage(download.download(wanted, f"{a.out}/filings", a.year, download.HttpGetter(a.agent), folder, a.overwrite), "status")
    report = index_records.status_report(done)
    sinks.write_table(report, f"{a.out}/download_report.csv")
    tickers = done.where("status = 'downloaded'").select(F.col("fiscal_year").cast("string").alias("fiscal_year"), F.col("cik_padded").alias("cik"), F.try_element_at("ticker_symbols", F.lit(1)).alias("ticker"), F.lit("filing").alias("source"), F.current_timestamp().cast("string").alias("updated_at"))
    # the last writer of a year and firm counts
    sinks.write_new(tickers.where("ticker IS NOT NULL").dropDuplicates(["fiscal_year", "cik"]), f"{a.out}/tickers", ["fiscal_year", "cik"], (), True)
    return report


def _extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.filing_dir:
        found = files.filings(spark, a.filing_dir, a.filing, a.year, a.id)
    else:
        found = spark.read.parquet(f"{a.out}/filings").where(F.col("form") == a.filing).select("cik", "year", "form", "source_path", "html")
        found = found.where(F.col("year").isin(a.year)) if a.year else found
    items = filings.extract_items(found)
    if a.task in ("items", "both"):
        sinks.write_new(items, f"{a.out}/items", ["cik", "year", "form", "item_id"], ("year", "form"), a.overwrite, ["cik", "year", "form"])
    if a.task in ("structure", "both"):
        nodes = filings.structure_nodes(items.where("error IS NULL").drop("text_content"))
        sinks.write_new(nodes, f"{a.out}/nodes", ["cik", "year", "form", "item_id"], ("year", "form"), a.overwrite, ["cik", "year", "form"])
    if a.json:
        if a.task in ("items", "both"):
            sinks.write_items(items, a.json)
        if a.task in ("structure", "both"):
            sinks.write_structures(nodes, a.json)
    return items.groupBy("form", "year").agg(F.count("*").alias("items"), F.count("error").alias("errors"))


def _items(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(f"{a.out}/items").where((F.col("form") == a.filing) & F.col("error").isNull())
    rows = rows.where(F.col("year").isin(a.year)) if a.year else rows
    rows = rows.where(F.col("item_id").isin([i.upper() for i in a.item])) if getattr(a, "item", None) else rows
    kept = [F.col("cik").alias("firm_id"), "year", "form", "item_id"]
    there = F.coalesce(F.btrim("text_content") != "", F.lit(False))
    # items without text are read from their HTML
    bare = filings.html_texts(rows.where(~there).select("cik", "year", "form", "item_id", "html_content"), "html_content", "visible")
    return rows.where(there).select(*kept, F.col("text_content").alias("text")).unionByName(bare.select(*kept, "text"))


def _generator(a: argparse.Namespace, offline: models.Generator) -> models.Generator:
    return models.HttpGenerator(a.llm, a.url, a.timeout) if a.url else offline


def _summarize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    keys = ["firm_id", "form", "item_id"]
    items = models.with_previous_year(_items(spark, a), keys, "text")
    if not a.overwrite and sinks.exists(spark, f"{a.out}/summaries"):
        items = items.join(spark.read.parquet(f"{a.out}/summaries").select(*keys, "year").distinct(), [*keys, "year"], "left_anti")
    done = models.summarize(items.withColumn("_id", F.col("item_id")), [*keys, "year", "previous_year_available"], "_id", "text", _generator(a, models.lead_words()), a.llm, a.target_words, not a.no_map_reduce)
    if a.json:
        done = stage(done, "summaries")
        sinks.write_summaries(done, a.json)
    sinks.write_new(done, f"{a.out}/summaries", [*keys, "year"], ("year",), a.overwrite)
    return spark.read.parquet(f"{a.out}/summaries").groupBy("year").count()


def _scope_texts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """firm_id, year, item_id, text of the scope asked for."""
    if a.scope == "all":
        return _items(spark, a).drop("form")
    if a.scope == "summary":
        rows = spark.read.parquet(f"{a.out}/summaries").where(F.col("form") == a.filing).select("firm_id", "year", "item_id", F.col("summary").alias("text"))
    else:
        nodes = spark.read.parquet(f"{a.out}/nodes").where(F.col("form") == a.filing).withColumn("firm_id", F.col("cik"))
        rows = filings.field_text(nodes, ["firm_id", "year", "item_id"], a.scope)
    rows = rows.where(F.col("year").isin(a.year)) if a.year else rows
    return rows.where(F.col("item_id").isin([i.upper() for i in a.item])) if a.item else rows


def _vectors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    keys = ["firm_id", "year", "item_id"]
    embedder, name = vectors.embedder(a.embed_model, a.dim), f"hash-{a.dim}" if a.embed_model == "hash" else a.embed_model
    texts = _scope_texts(spark, a)
    if a.scope == "summary":
        units = texts.where("trim(text) <> ''").select(*keys, F.lit(1).alias("unit_id"), F.col("text").alias("unit_text"), F.lit(None).cast("int").alias("chunk_tokens"), F.lit(None).cast("int").alias("overlap_tokens"), X.token_count(F.col("text")).alias("unit_tokens"))
    else:
        units = chunks.units(texts.withColumnRenamed("item_id", "_raw"), ["firm_id", "year"], "_raw", "text", a.chunk_tokens, a.overlap_tokens, a.min_unit_tokens, a.min_units_per_item, chunks.FileCounter(a.tokenizer) if a.tokenizer else None)
    units = stage(vectors.embed(units, "unit_text", embedder), "units")
    sinks.write_new(units.withColumn("scope", F.lit(a.scope)).drop("embedding"), f"{a.out}/units", [*keys, "unit_id", "scope"], ("scope", "year"), a.overwrite, [*keys, "scope"])
    dim = units.select(F.size("embedding").alias("n")).where("n > 0").limit(1).collect()
    pooled = vectors.distinctiveness_pool(units, keys, "embedding", dim[0].n if dim else a.dim)
    sizes = units.groupBy(*keys).agg(F.sum("unit_tokens").alias("item_tokens"), F.max("chunk_tokens").alias("chunk_tokens"), F.max("overlap_tokens").alias("overlap_tokens"))
    out = pooled.join(sizes, keys).select(*keys, "num_units", "item_tokens", F.col("pooled").cast("array<float>").alias("pooled_embedding"), "chunk_tokens", "overlap_tokens", "w_max", "w_mean", F.lit(name).alias("embedding_model"), F.lit(a.scope).alias("scope"))
    sinks.write_new(out, f"{a.out}/item_vectors", [*keys, "scope"], ("scope", "item_id", "year"), a.overwrite)
    if a.matrices:
        matrices.write_matrices(out.select(F.col("firm_id").alias("firm"), "year", "item_id", F.col("pooled_embedding").alias("vec")), f"{a.matrices}/{a.scope}")
    return out.groupBy("item_id", "year").agg(F.count("*").alias("vectors"))


def _peers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    items = sorted({i.upper() for i in a.item})
    rows = spark.read.parquet(f"{a.out}/item_vectors").where((F.col("scope") == a.scope) & F.col("year").isin(a.year) & F.col("item_id").isin(items))
    rows = rows.select(F.col("firm_id").cast("string").alias("firm"), "year", F.col("item_id").cast("string").alias("item_id"), F.col("pooled_embedding").alias("vec"))
    found = vectors.candidates(rows, F.col("firm").isin([f.zfill(10) for f in a.focalfirm]), a.q_share)
    texts = _scope_texts(spark, a).withColumnRenamed("firm_id", "firm")
    detail = models.rerank(found, texts, _generator(a, models.overlap_scorer), a.max_chars)
    sinks.write_table(detail, f"{a.peer_path}_detail.parquet")
    final = peers.final_ranking(detail, len(items), a.top_share)
    sinks.write_table(final, f"{a.peer_path}.parquet")
    return final


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    ranking = files.any_table(spark, a.peer_path, "focal_firm STRING, year INT, peer_firm STRING, rank INT")
    empty = spark.createDataFrame([], "focal_firm STRING, year INT, peer_firm STRING")
    labels = evaluate.weak_labels(files.any_table(spark, a.metadata_path, files.METADATA)) if a.metadata_path else empty
    if a.analyst_path:
        labels = evaluate.with_analysts(labels, files.any_table(spark, a.analyst_path, files.ANALYSTS))
    measured = evaluate.metrics(ranking, labels)
    sinks.write_table(measured, f"{a.out}/metrics.parquet")
    sinks.write_table(evaluate.stability(ranking), f"{a.out}/stability.parquet")
    total = evaluate.summary(measured)
    total.coalesce(1).withColumn("run_at", F.current_timestamp()).withColumn("peer_path", F.lit(a.peer_path)).write.mode("append").json(f"{a.out}/runs")
    return total


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="peerlens", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *, years: bool = True, filing: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--out", required=True)
        if years:
            p.add_argument("--year", type=int, nargs="*", default=[])
        if filing:
            p.add_argument("--filing", default="10-K")
        p.add_argument("--overwrite", action="store_true")
        return p

    p = add("index", _index)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--index", nargs="+", help="company.idx files")
    source.add_argument("--fetch", nargs="+", type=int, help="years whose quarterly files are fetched")
    p.add_argument("--base", default=f"{download.BASE}/Archives/edgar/full-index")
    p.add_argument("--agent")
    p.add_argument("--list_only", action="store_true", help="only report how many filings the fiscal years have")
    p.add_argument("--id", nargs="*", default=[])
    p.add_argument("--tickers")
    p.add_argument("--legacy_tickers", help="map that is read if the other one is empty or missing")
    p.add_argument("--lookahead", type=int, default=config.LOOKAHEAD)
    p = add("download", _download)
    p.add_argument("--agent", required=True)
    p.add_argument("--lookahead", type=int, default=config.LOOKAHEAD)
    p = add("extract", _extract)
    p.add_argument("--filing_dir", help="folders of HTML files; else the table of filings in --out")
    p.add_argument("--id", nargs="*", default=[])
    p.add_argument("--task", choices=["items", "structure", "both"], default="both")
    p.add_argument("--json", help="folder for JSON artifacts beside the tables")
    p = add("summarize", _summarize)
    p.add_argument("--llm", default="llama3.2:3b")
    p.add_argument("--url")
    p.add_argument("--target_words", type=int, default=config.TARGET_WORDS)
    p.add_argument("--timeout", type=float, default=300.0)
    p.add_argument("--no_map_reduce", action="store_true")
    p.add_argument("--json", help="folder for JSON artifacts beside the table")
    p = add("vectors", _vectors)
    p.add_argument("--scope", choices=["all", "heading", "body", "summary"], default="all")
    p.add_argument("--item", nargs="*", default=[])
    p.add_argument("--embed_model", default="hash", help="hash, or the name of a sentence-transformers model")
    p.add_argument("--dim", type=int, default=384, help="length of hash vectors")
    p.add_argument("--matrices", help="folder for matrix files")
    p.add_argument("--tokenizer", help="tokenizer file (JSON) by whose tokens paragraphs are packed; else words count")
    p.add_argument("--chunk_tokens", type=int)
    p.add_argument("--overlap_tokens", type=int)
    p.add_argument("--min_unit_tokens", type=int, default=config.MIN_UNIT_TOKENS)
    p.add_argument("--min_units_per_item", type=int, default=config.MIN_UNITS)
    p = add("peers", _peers)
    p.add_argument("--scope", choices=["all", "heading", "body", "summary"], default="all")
    p.add_argument("--focalfirm", nargs="+", required=True)
    p.add_argument("--item", nargs="+", required=True)
    p.add_argument("--q_share", type=float, default=config.Q_SHARE)
    p.add_argument("--top_share", type=float, default=config.TOP_SHARE)
    p.add_argument("--max_chars", type=int, default=config.MAX_CHARS)
    p.add_argument("--llm", default="llama3.2:8b")
    p.add_argument("--url")
    p.add_argument("--timeout", type=float, default=300.0)
    p.add_argument("--peer_path", required=True)
    p = add("evaluate", _evaluate, years=False, filing=False)
    p.add_argument("--peer_path", required=True)
    p.add_argument("--metadata_path")
    p.add_argument("--analyst_path")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("peerlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = args.run(spark, args)
    result.show(50, truncate=False)
    return result


def _end() -> None:
    main()
    release()


if __name__ == "__main__":
    _end()
