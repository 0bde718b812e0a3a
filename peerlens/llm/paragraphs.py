"""Paragraphs that many records share almost word for word, by MinHash banding over paragraphs.

This is the paragraph form of problem 5: bands tuned for high recall join paragraphs that collide, every pair is
verified by its exact Jaccard similarity, and linked paragraphs form clusters, of which all but the first are
removals. The exact stretches of characters are found by spans.shared_spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.similar import similar_pairs
from peerlens.plans import stage

_BLANK = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*")


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, paragraph (from 0), start_pos, end_pos, text: what stands between blank lines, blank paragraphs left out."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                start, n = 0, 0
                for end, after in [*(m.span() for m in _BLANK.finditer(text)), (len(text), len(text))]:
                    if text[start:end].strip():
                        rows.append((at, n, start, end, text[start:end]))
                        n += 1
                    start = after
            columns = list(zip(*rows)) or [()] * 5
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.string())))], ["id", "paragraph", "start_pos", "end_pos", "text"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, f"id {kind.simpleString()}, paragraph INT, start_pos BIGINT, end_pos BIGINT, text STRING").withColumnRenamed("id", id_col)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each node is connected to, of the nodes in the edges.

    Alternates linking each node's larger neighbours to its smallest neighbour, and its smaller ones likewise, until
    every node hangs on its root: as many rounds as that takes, about the logarithm of the largest component. Each round
    is staged; only the number of edges that changed comes to the driver.
    """
    kind = edges.schema[a].dataType.simpleString()
    links = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")

    def star(of: DataFrame, large: bool) -> DataFrame:
        both = of.unionByName(of.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else of
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        moved = joined.where("v > u") if large else joined.unionByName(least.select("u", F.col("u").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    while True:
        new = stage(star(stage(star(links, True), "large-star"), False), "small-star")
        if not new.join(links, ["u", "v"], "left_anti").limit(1).count() and new.count() == links.count():
            break
        links = new
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct().select(F.col("node").cast(kind), F.col("root").cast(kind))


def shared_paragraphs(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, least_words: int = 20, rows: int = 6) -> DataFrame:
    """Paragraphs that are linked to one of another record or place: id (under its own name), paragraph, start_pos,
    end_pos, cluster (the smallest name record:paragraph in it), removable (true for all but that one).

    Equal paragraphs are linked whatever their length, others by their similarity if they have `least_words` words. With
    6 samples a band a pair of similarity 0.8 is missed with probability 0.000003. Null and blank texts and rows without
    id take no part; repeated rows of an id count once.
    """
    found = paragraphs(df, id_col, text_col).select(F.col(id_col).alias("id"), "paragraph", "start_pos", "end_pos", "text")
    named = found.withColumn("name", F.concat_ws(":", F.col("id").cast("string"), F.col("paragraph").cast("string")))
    pairs = similar_pairs(named, "name", "text", shingle, threshold, least_words, rows)
    places = named.select(F.md5("text").alias("same"), F.col("name").alias("row_b"))
    equal = places.join(places.groupBy("same").agg(F.min("row_b").alias("row_a")), "same").where("row_a <> row_b").select("row_a", "row_b").distinct()
    roots = components(stage(pairs.unionByName(equal), "paragraph-pairs"), "row_a", "row_b")
    out = named.drop("text").join(roots.withColumnRenamed("node", "name"), "name").dropDuplicates(["name"])
    return out.select(F.col("id").alias(id_col), "paragraph", "start_pos", "end_pos", F.col("root").alias("cluster"), (F.col("name") != F.col("root")).alias("removable"))
