"""Writers: incremental tables, partitioned vectors, rankings, reports, JSON artifacts."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.plans import stage


#: Partitions up to which a batch's own ones are listed; beyond, the keys of the whole table are read.
MOST_PARTITIONS = 200


def exists(df_or_spark, path: str) -> bool:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_new(df: DataFrame, path: str, keys: list[str], partitions: tuple[str, ...] = (), overwrite: bool = False, unit: list[str] | None = None) -> None:
    """Appends the rows whose keys the table lacks, of which only the partitions of df are read; with overwrite, replaces the rows that agree with one of df in `unit`
    (the keys, if it isn't given) and keeps all others.

    What is replaced is staged with what is kept before the table is touched: partitions of df are then overwritten, a
    table without partitions is written beside the old one and takes its place.
    """
    writer = lambda d: d.write.partitionBy(*partitions) if partitions else d.write
    if not exists(df, path):
        writer(df).mode("overwrite").parquet(path)
    elif overwrite:
        _replace(stage(df, "new-rows"), path, unit or keys, partitions, writer)
    else:
        have = df.sparkSession.read.schema(df.schema).parquet(path)
        inside = [p for p in partitions if p in keys]
        if inside and len(found := df.select(*inside).distinct().limit(MOST_PARTITIONS + 1).collect()) <= MOST_PARTITIONS:
            same = lambda r: reduce(and_, (F.col(p).eqNullSafe(F.lit(r[p])) for p in inside))
            have = have.where(reduce(or_, map(same, found), F.lit(False)))
        writer(df.join(have.select(*keys).distinct(), keys, "left_anti")).mode("append").parquet(path)


def _replace(df: DataFrame, path: str, unit: list[str], partitions: tuple[str, ...], writer) -> None:
    spark = df.sparkSession
    old = spark.read.schema(df.schema).parquet(path)

    def of(columns: Sequence[str], how: str) -> DataFrame:
        mine = df.select(*(F.col(c).alias(f"_new_{c}") for c in columns)).distinct()
        return old.join(mine, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns]), how)

    if partitions:
        old = of(partitions, "left_semi")
    merged = stage(of(unit, "left_anti").unionByName(df), "replaced")
    if partitions:
        writer(merged).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    name = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    files, bare, mark = name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path.rstrip("/"), uuid.uuid4().hex
    writer(merged).parquet(f"{bare}.new-{mark}")
    for source, target in ((bare, f"{bare}.old-{mark}"), (f"{bare}.new-{mark}", bare)):
        if not files.rename(name(source), name(target)):
            raise OSError(f"{source} can't be renamed to {target}")
    files.delete(name(f"{bare}.old-{mark}"), True)
    spark.catalog.refreshByPath(bare)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet if the path ends so, else CSV with a header."""
    if path.lower().endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", "true").csv(path)


def shared_uri(root: str) -> str:
    """The URI of a folder that all executors share; a path without scheme is a file path."""
    if root.startswith("file:"):
        return "file://" + root.removeprefix("file:").removeprefix("//")
    return root if "://" in root else "file://" + os.path.abspath(root)


def write_files(rows: DataFrame, root: str, path: Column, content: Column) -> int:
    """Writes each row's text as a file of its own below root, a folder that all executors share, and returns how many. A
    file is written beside its place and then moved there, so that a task that runs again leaves whole files."""
    uri = shared_uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{folder.rstrip('/')}/{name}"
                beside = f"{target}.{uuid.uuid4().hex}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(beside) as f:
                    f.write(text.encode())
                fs.move(beside, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    chosen = rows.select(path.alias("path"), content.alias("content")).where("path IS NOT NULL AND content IS NOT NULL")
    return chosen.mapInArrow(run, "n BIGINT").agg(F.sum("n")).first()[0] or 0


def artifact_path(suffix: str, cik: str = "cik", year: str = "year", form: str = "form") -> Column:
    """<cik>/<year>/<form>/<cik>_<year>_<form><suffix>."""
    parts = [F.col(c).cast("string") for c in (cik, year, form)]
    return F.concat(F.concat_ws("/", *parts), F.lit("/"), F.concat_ws("_", *parts), F.lit(suffix))


def write_items(items: DataFrame, root: str) -> int:
    """An _item.json for each filing, as files.item_files reads it, of rows as filings.extract_items gives them (cik, year,
    form, source_path, item_id, item_title, anchor, html_content, text_content, error)."""
    entry = F.struct(F.col("item_id").alias("item_number"), "item_title", "html_content", "text_content", "error")
    link = F.struct("anchor", F.col("item_title").alias("title"))
    of = lambda v: F.map_from_entries(F.array_distinct(F.sort_array(F.collect_list(F.struct(F.col("item_id").alias("key"), v.alias("value"))))))
    filed = items.groupBy("cik", "year", "form", "source_path").agg(of(link).alias("toc_items"), of(entry).alias("items"))
    body = F.to_json(F.struct("cik", F.col("year").cast("string").alias("year"), F.col("form").alias("filing"), F.col("source_path").alias("source_file"), "toc_items", "items"))
    return write_files(filed, root, artifact_path("_item.json"), body)


def write_summaries(summaries: DataFrame, root: str) -> int:
    """An _item_summ.json for each filing, as files.summary_files reads it, of firm_id, year, form, item_id, summary,
    target_words, llm, previous_year_available."""
    entry = F.struct("summary", "target_words", "llm", F.lit(None).cast("string").alias("source_path"), "previous_year_available")
    filed = summaries.groupBy("firm_id", "year", "form").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item_id", entry)))).alias("items"))
    body = F.to_json(F.struct("firm_id", "year", F.col("form").alias("filing_type"), "items"))
    return write_files(filed, root, artifact_path("_item_summ.json", "firm_id"), body)


def write_structures(nodes: DataFrame, root: str) -> int:
    """A _str.json for each filing, as files.structure_files reads it, of rows as filings.structure_nodes gives them: each
    item's nodes nested again."""
    node = F.struct("node_ord", "parent_ord", "type", "layer", "heading", "body")
    trees = nodes.groupBy("cik", "year", "form", "item_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    item = F.struct("item_id", "nodes")
    filed = trees.groupBy("cik", "year", "form").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("flat"))

    @F.pandas_udf("string")
    def nested(flat: pd.Series) -> pd.Series:
        def tree(rows: list[dict]) -> list[dict]:
            made = [{k: r.get(k) for k in ("type", "layer", "heading", "body")} | {"children": []} for r in rows]
            for r, m in zip(rows, made):
                if r["parent_ord"] >= 0:
                    made[r["parent_ord"]]["children"].append(m)
            return [m for r, m in zip(rows, made) if r["parent_ord"] < 0]

        return flat.map(lambda text: json.dumps({"structures": {i["item_id"]: tree(i["nodes"]) for i in json.loads(text)}}))

    return write_files(filed, root, artifact_path("_str.json"), nested("flat"))


def write_json(items: DataFrame, path: str, keys: list[str], key: str, fields: list[str], name: str = "items") -> None:
    """One JSON object for each value of keys, with a map `name` from `key` to the fields, partitioned by the keys."""
    entry = F.struct(F.col(key), F.struct(*fields))
    nested = items.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))
    nested.write.mode("overwrite").partitionBy(*keys).json(path)


def markdown(report: DataFrame, title: str, most: int = 1000) -> str:
    """A small report as a Markdown table; more than `most` rows are refused, not cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(report.columns), line(["---"] * len(report.columns)), *map(line, rows), ""])
