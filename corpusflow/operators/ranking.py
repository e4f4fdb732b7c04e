"""Fusing, collapsing, grading and ordering ranked lists.

A ranked list is long-form: ``query_id, list_no, chunk_id, rank, weight`` plus
the half (``dense`` or ``keyword``), its raw ``score`` and the phrasing number.
After the top-k cut a query owns at most lists x k rows, so the windows below
are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
MIN_SIMILARITY = 0.2
OVERFETCH = 4
ACCEPT_SCORE = 0.5
REJECT_SCORE = 0.001
FUSED_DIGITS = 12


def similarity_floor(hits: DataFrame, floor: float = MIN_SIMILARITY) -> DataFrame:
    """Drop weak dense hits; keyword hits never pass through here."""
    return hits.filter(F.col("score") >= floor)


def rerank_floor(hits: DataFrame, floor: float = 0.0) -> DataFrame:
    return hits.filter(F.col("rerank_score") >= floor)


def as_list(hits: DataFrame, half: str, variant_no: Column | int, weight: float = 1.0) -> DataFrame:
    """One half's hits as a ranked list; dense precedes keyword per phrasing."""
    variant = F.lit(variant_no) if isinstance(variant_no, int) else variant_no
    return hits.select(
        "query_id",
        (variant * 2 + (0 if half == "dense" else 1)).cast("int").alias("list_no"),
        F.concat(
            F.lit(f"{half}:"),
            F.when(variant == 0, "original").otherwise(F.concat(F.lit("variant"), variant.cast("string"))),
        ).alias("list_name"),
        F.lit(half).alias("half"),
        variant.cast("int").alias("variant_no"),
        "chunk_id",
        "rank",
        "score",
        F.lit(float(weight)).alias("weight"),
    )


def union_lists(*lists: DataFrame) -> DataFrame:
    """All lists in one table; zero-weight lists are dropped."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.filter(F.col("weight") > 0)


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion with provenance, one row per (query, chunk).

    A query with a single non-empty list keeps that list's own scores and
    order. Ties go to the chunk that appeared first across the lists.
    """
    dense = F.when(F.col("half") == "dense", F.col("score"))
    keyword = F.when(F.col("half") == "keyword", F.col("score"))
    merged = rankings.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("fused"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"),
        F.max(dense).alias("dense_score"),
        F.max(keyword).alias("keyword_score"),
        F.min("variant_no").alias("found_by_variant"),
        F.min_by("score", "list_no").alias("own_score"),
        F.min("list_no").alias("low_list"),
        F.max("list_no").alias("high_list"),
    )
    per_query = Window.partitionBy("query_id")
    single = F.min("low_list").over(per_query) == F.max("high_list").over(per_query)
    return (
        merged.withColumn("single", single)
        .withColumn("score", F.when(F.col("single"), F.col("own_score")).otherwise(F.col("fused")))
        .withColumn(
            "matched_by",
            F.when(F.col("dense_score").isNotNull() & F.col("keyword_score").isNotNull(), "both")
            .when(F.col("keyword_score").isNotNull(), "keyword")
            .otherwise("dense"),
        )
        .withColumn("rank", F.row_number().over(per_query.orderBy(*fused_order())))
        .select(
            "query_id", "chunk_id", "rank", "score", "dense_score", "keyword_score",
            "matched_by", "found_by_variant",
        )
    )


def fused_order() -> list[Column]:
    return [
        F.when(F.col("single"), F.lit(0.0)).otherwise(F.round("fused", FUSED_DIGITS)).desc(),
        F.col("first_seen").asc(),
    ]


def collapse_passages(ranked: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Keep the best chunk per passage; a chunk without parent stands alone."""
    key = F.coalesce(F.nullif(F.col(parent), F.lit("")), F.concat(F.lit("chunk\0"), F.col("chunk_id").cast("string")))
    best = Window.partitionBy("query_id", key).orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        ranked.withColumn("_first", F.row_number().over(best))
        .filter("_first = 1")
        .drop("_first")
        .withColumn("rank", F.row_number().over(order))
    )


def rerank_order(ranked: DataFrame) -> DataFrame:
    """Stable order by rerank score, retrieval order as tie-break."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank").asc())
    return ranked.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")


def cut(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def verdict(best: Column, accept: float = ACCEPT_SCORE, reject: float = REJECT_SCORE) -> Column:
    if reject > accept:
        raise ValueError("the reject score must not exceed the accept score")
    return (
        F.when(best >= accept, "correct")
        .when(best.isNull() | (best < reject), "incorrect")
        .otherwise("ambiguous")
    )


def grade(
    queries: DataFrame, reranked: DataFrame, accept: float = ACCEPT_SCORE, reject: float = REJECT_SCORE
) -> DataFrame:
    """``query_id, best_score, verdict``; a query without hits is incorrect."""
    best = reranked.groupBy("query_id").agg(F.max("rerank_score").alias("best_score"))
    return (
        queries.select("query_id")
        .join(best, "query_id", "left")
        .withColumn("verdict", verdict(F.col("best_score"), accept, reject))
    )
