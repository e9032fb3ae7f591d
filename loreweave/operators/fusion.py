"""Fusing rankings: reciprocal rank fusion with absorption of page hits, gates, reranking, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(lexical: DataFrame, vector: DataFrame, limit: int = 10, k: int = K) -> DataFrame:
    """Fuse page hits with anchored hits: query_id, path, anchor, rank, score.

    ``lexical`` has query_id, path, rank (from 1); ``vector`` also anchor (null for a page hit). A hit adds
    1 / (k + rank). A page's lexical share goes to its best-ranked anchor; its other anchors keep their own, and a page
    without anchors stays a page. Order: score, then first appearance (lexical list first).
    """
    page = lexical.groupBy("query_id", "path").agg(F.sum(1.0 / (k + F.col("rank"))).alias("page_score"), F.min("rank").alias("page_rank"))
    hits = vector.groupBy("query_id", "path", "anchor").agg(F.sum(1.0 / (k + F.col("rank"))).alias("own"), F.min("rank").alias("first"))
    best = Window.partitionBy("query_id", "path").orderBy(F.col("anchor").isNull(), "first")
    hits = hits.withColumn("_best", F.row_number().over(best) == 1)
    both = page.join(hits, ["query_id", "path"], "full")
    share = F.when(F.col("_best").isNull() | F.col("_best"), F.coalesce("page_score", F.lit(0.0))).otherwise(0.0)
    fused = both.select(
        "query_id",
        "path",
        "anchor",
        F.round(share + F.coalesce("own", F.lit(0.0)), 9).alias("score"),
        F.when(F.col("_best").isNull(), F.struct(F.lit(0).alias("list"), F.col("page_rank").alias("at"))).otherwise(F.struct(F.lit(1).alias("list"), F.col("first").alias("at"))).alias("_seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_seen", "path")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_seen")


def one_per_page(hits: DataFrame) -> DataFrame:
    """The first hit of each page, in order of rank."""
    first = Window.partitionBy("query_id", "path").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def merge_by_score(engines: list[DataFrame], limit: int) -> DataFrame:
    """Union of several engines' best max(3, round(limit / engines)) hits, by raw score."""
    each = max(3, int(limit / len(engines) + 0.5))
    every = None
    for at, hits in enumerate(engines):
        part = hits.where(F.col("rank") <= each).withColumn("_engine", F.lit(at))
        every = part if every is None else every.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_engine", "rank", "path")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_engine")


def rerank(hits: DataFrame) -> DataFrame:
    """By judged relevance (0.5 where there is none), then score, then rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("relevance", F.lit(0.5))), F.desc("score"), "rank", "path")
    return hits.withColumn("judged_rank", F.row_number().over(order))


def gate(hits: DataFrame, sufficiency: DataFrame, least: float = 0.5, midpoint: float = 0.5) -> DataFrame:
    """Hits of queries that are judged sufficient (no judgement: none pass), with relevance from the midpoint up."""
    passed = sufficiency.where(F.coalesce("sufficiency", F.lit(-1.0)) >= least).select("query_id")
    return hits.join(passed, "query_id", "left_semi").where(F.coalesce("relevance", F.lit(0.5)) >= midpoint)


def within_budget(hits: DataFrame, budget: int, text: str = "excerpt") -> DataFrame:
    """Hits in order of rank while their texts' running length stays in the budget; one at least."""
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = hits.withColumn("used", F.sum(F.length(text)).over(running)).withColumn("_n", F.count(F.lit(1)).over(running))
    return sized.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")
