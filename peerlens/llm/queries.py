"""The registered queries of the problems, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import leaks, neighbors, paragraphs, similar, spans, splitting, tokens, topn, truncation
from peerlens.llm.oracle import SQL
from peerlens.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbour_pairs(table(spark, d, "vector_matrix"), "vec_id", "mat", dim=64, k=10, least=0.85)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "peer_ranking")
    focal, peer = topn.padded_id(t.focal_firm), topn.padded_id(t.peer_firm)
    rows = t.select(focal.alias("focal_firm"), t.year, peer.alias("peer_firm"), t.score).where("focal_firm IS NOT NULL AND peer_firm IS NOT NULL AND focal_firm <> peer_firm AND score BETWEEN 0 AND 100")
    top = topn.top_n_per_group(rows, ["focal_firm", "year"], "peer_firm", "score", 10)
    return top.select("focal_firm", "year", F.col("item").alias("peer_firm"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "filing_item"), "row_id", "text_content", 2000, 1000, 200)


def p3_bisect(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "filing_item"), "row_id", "text_content", 2000, 1000, 200, "even")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(table(spark, d, "filing_item"), "row_id", "text_content", shingle=3, threshold=0.6, least_words=20, copies="text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "filing_item"), "row_id", "text_content", 200)


def p5_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "filing_item"), "row_id", "text_content", 200)


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.shared_paragraphs(table(spark, d, "filing_item"), "row_id", "text_content")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = tokens.decode(tokens.encode(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")
    return back.select("doc_id", F.md5("text").alias("text_md5"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "passage_id", "passage", 13).select("doc_id", "passage_id")


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 24 words that differ in at most two words from a passage's."""
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "passage_id", "passage", 24, edits=2, sampled=8, recall=0.99).select("doc_id", "passage_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"), "doc_id", "text", "lang", "source").where("cut").select(F.col("id").alias("doc_id")).distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"), "doc_id", "text", "source", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_bisect, p4_found, p5_found, p5_share, p5_paragraphs, p6_ids, p6_round_trip, p7_found, p7_edited, p8_found, p8_rates)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
