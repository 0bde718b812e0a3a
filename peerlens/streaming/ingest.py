"""Incremental ingest with Structured Streaming: the same operators on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators.filings import extract_items
from peerlens.sources.files import path_part
from peerlens.sources.sinks import write_new


def filing_stream(spark: SparkSession, root: str, files_a_trigger: int = 1000) -> DataFrame:
    """Filings under root as they arrive: cik, year, form, source_path, html."""
    reader = spark.readStream.schema("value STRING").format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    rows = reader.option("pathGlobFilter", "*.{htm,html}").option("maxFilesPerTrigger", files_a_trigger).load(root)
    return rows.select(*(path_part(n).alias(n) for n in ("cik", "year", "form")), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("html"))


def ingest_items(spark: SparkSession, root: str, table: str, checkpoint: str, files_a_trigger: int = 1000):
    """Extracts the items of all filings that aren't in the table yet and ends; a restart goes on where it stopped, and
    a repeated batch adds nothing."""
    items = extract_items(filing_stream(spark, root, files_a_trigger))

    def sink(batch: DataFrame, _: int) -> None:
        write_new(batch, table, ["cik", "year", "form", "item_id"], ("year", "form"))

    return items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(records: DataFrame, time: str, keys: list[str], delay: str = "7 days") -> DataFrame:
    """A stream without repeated keys within the delay; state older than the watermark is dropped."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(records: DataFrame, time: str, key: str, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """window_start, key, n of a stream, late rows within the delay included."""
    counts = records.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")
