"""Peer rankings: cleaning, score fusion, aggregation over items, final cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.config import COSINE_WEIGHT, RERANK_WEIGHT, TOP_SHARE
from peerlens.functions import text as X


def clean_scores(ranking: DataFrame) -> DataFrame:
    """focal_firm, year, peer_firm, score: ids padded, the best score from 0 to 100 of each; rows of a firm with itself
    or without ids or a usable score are left out."""
    rows = ranking.select(X.cik(F.col("focal_firm")).alias("focal_firm"), "year", X.cik(F.col("peer_firm")).alias("peer_firm"), "score")
    rows = rows.where("focal_firm <> peer_firm AND score BETWEEN 0 AND 100")
    return rows.groupBy("focal_firm", "year", "peer_firm").agg(F.max("score").alias("score"))


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds rank within (focal_firm, year), ties by ascending peer."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("focal_firm", "year").orderBy(F.desc(score), "peer_firm")))


def fuse(cosine: Column, rerank: Column) -> Column:
    return cosine * COSINE_WEIGHT + rerank * RERANK_WEIGHT


def final_ranking(detail: DataFrame, requested_items: int, top_share: float | None = TOP_SHARE) -> DataFrame:
    """focal_firm, year, peer_firm, items_matched, avg_cosine, avg_rerank, avg_item_score, coverage_share, final_score,
    rank.

    detail: focal_firm, year, item_id, peer_firm, cosine_score, rerank_score, universe_n. Coverage counts against the
    items asked for, even those that a year lacks. Of each focal firm and year max(1, ceil(n * top_share)) peers are
    kept, n being the largest universe; all with top_share None. Scores are rounded to 6 places. Rows without a
    rerank_score don't count.
    """
    rows = detail.where("rerank_score IS NOT NULL").withColumn("_s", fuse(F.col("cosine_score"), F.col("rerank_score")))
    mean = lambda c: F.round(F.avg(c), 6)
    g = rows.groupBy("focal_firm", "year", "peer_firm").agg(F.count_distinct("item_id").alias("items_matched"), mean("cosine_score").alias("avg_cosine"), mean("rerank_score").alias("avg_rerank"), mean("_s").alias("avg_item_score"), F.max("universe_n").alias("_u"))
    g = g.withColumn("coverage_share", F.round(F.col("items_matched") / max(1, requested_items), 6))
    g = g.withColumn("final_score", F.round(F.col("avg_item_score") * F.col("coverage_share"), 6))
    by = Window.partitionBy("focal_firm", "year")
    order = by.orderBy(F.desc("final_score"), F.desc("avg_rerank"), F.desc("avg_cosine"), "peer_firm")
    g = g.withColumn("rank", F.row_number().over(order)).withColumn("_u", F.max("_u").over(by))
    if top_share is not None:
        g = g.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("_u") * top_share)))
    return g.drop("_u")
