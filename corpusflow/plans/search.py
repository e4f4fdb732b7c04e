"""Batch question answering: lists, fusion, collapse, rerank, grade, refuse.

``chunks``: ``chunk_id, text, embedding`` plus metadata (``parent_id``, ...).
``questions``: ``query_id, variant_no, text, embedding``; variant 0 is the
question itself. Both vectors may be NULL, such rows have no dense hits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.models import Scorer, overlap_score
from corpusflow.operators import ranking as rk
from corpusflow.operators.dense import dense_topk
from corpusflow.operators.keyword import bm25_topk, require_positive
from corpusflow.operators.sizing import at_most
from corpusflow.session import staged

MODES = ("dense", "keyword", "hybrid")
NO_ANSWER = (
    "I don't know. No relevant information was found in the ingested documents "
    "to answer this question."
)


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    overfetch: int = rk.OVERFETCH
    mode: str = "hybrid"
    min_similarity: float = rk.MIN_SIMILARITY
    rrf_k: int = rk.RRF_K
    dense_weight: float = 1.0
    keyword_weight: float = 1.0
    rerank_min: float = 0.0
    accept: float = rk.ACCEPT_SCORE
    reject: float = rk.REJECT_SCORE

    def __post_init__(self) -> None:
        require_positive(top_k=self.top_k, overfetch=self.overfetch)
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; valid: {', '.join(MODES)}")
        if self.reject > self.accept:
            raise ValueError("the reject score must not exceed the accept score")

    @property
    def candidates(self) -> int:
        return self.top_k * self.overfetch


def metadata_filter(df: DataFrame, **conditions: str | None) -> DataFrame:
    """AND of equalities, pushed to the scan; None and '' mean no condition."""
    for column, value in conditions.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == value)
    return df


def rankings(
    chunks: DataFrame, questions: DataFrame, cfg: Settings, vectors: DataFrame | None = None
) -> DataFrame:
    """One ranked list per (phrasing, half).

    ``vectors`` (``chunk_id, embedding``) is given where vectors are stored
    apart from the text, so that neither half reads the other's columns.
    """
    vectors = chunks if vectors is None else vectors
    # One number per phrasing, with as many places per question as the batch needs.
    places = (questions.agg(F.max("variant_no")).first()[0] or 0) + 1
    keyed = questions.withColumn("query_id", F.col("query_id").cast("bigint") * places + F.col("variant_no"))
    lists = []
    if cfg.mode in ("dense", "hybrid"):
        hits = rk.similarity_floor(
            dense_topk(vectors, keyed.select("query_id", "embedding"), cfg.candidates), cfg.min_similarity
        )
        lists.append(_split_key(hits, places, "dense", cfg.dense_weight if cfg.mode == "hybrid" else 1.0))
    if cfg.mode in ("keyword", "hybrid"):
        hits = bm25_topk(chunks, keyed.select("query_id", "text"), cfg.candidates)
        lists.append(_split_key(hits, places, "keyword", cfg.keyword_weight if cfg.mode == "hybrid" else 1.0))
    return rk.union_lists(*lists)


def _split_key(hits: DataFrame, places: int, half: str, weight: float) -> DataFrame:
    number = F.lit(places).cast("bigint")
    out = hits.withColumn("variant", F.pmod("query_id", number)).withColumn(
        "query_id", F.expr("query_id - variant").cast("bigint")
    ).withColumn("query_id", F.expr(f"query_id div {places}"))
    return rk.as_list(out, half, F.col("variant"), weight)


def with_chunk_columns(
    hits: DataFrame, chunks: DataFrame, questions: DataFrame, cfg: Settings, *columns: str
) -> DataFrame:
    """Attach chunk columns to the shortlist.

    The shortlist has at most questions x lists x candidates rows; while that
    product is small it is the broadcast side and the chunk table is only
    scanned, never shuffled.
    """
    limit = 500_000 // (cfg.candidates * 2)
    small = F.broadcast(hits) if at_most(questions, limit) else hits
    return small.join(chunks.select("chunk_id", *columns), "chunk_id")


def fused(
    chunks: DataFrame,
    questions: DataFrame,
    cfg: Settings,
    *columns: str,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Fused, passage-deduplicated shortlist with provenance."""
    hits = rk.fuse(rankings(chunks, questions, cfg, vectors), cfg.rrf_k)
    wide = with_chunk_columns(hits, chunks, questions, cfg, "parent_id", *columns)
    return rk.collapse_passages(wide)


def hybrid_search(
    chunks: DataFrame,
    questions: DataFrame,
    cfg: Settings = Settings(),
    *columns: str,
    vectors: DataFrame | None = None,
) -> DataFrame:
    return rk.cut(fused(chunks, questions, cfg, *columns, vectors=vectors), cfg.top_k)


def single_list_search(
    chunks: DataFrame,
    questions: DataFrame,
    mode: str,
    cfg: Settings = Settings(),
    *columns: str,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Dense or keyword only: raw scores, no fusion."""
    return hybrid_search(chunks, questions, replace(cfg, mode=mode), *columns, vectors=vectors)


def filtered_search(
    chunks: DataFrame, questions: DataFrame, cfg: Settings = Settings(), **conditions: str | None
) -> DataFrame:
    """Metadata filter, dense ranking, passage collapse; no similarity floor."""
    kept = metadata_filter(chunks, **conditions)
    hits = dense_topk(kept, questions.select("query_id", "embedding"), cfg.candidates)
    wide = with_chunk_columns(hits, kept, questions, cfg, "parent_id")
    return rk.cut(rk.collapse_passages(wide), cfg.top_k)


def reranked_search(
    chunks: DataFrame,
    questions: DataFrame,
    cfg: Settings = Settings(),
    scorer: Scorer = overlap_score,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Shortlist scored against the original question, then cut."""
    shortlist = fused(chunks, questions, cfg, "text", vectors=vectors)
    originals = questions.filter("variant_no = 0").select("query_id", F.col("text").alias("question"))
    scored = shortlist.join(originals, "query_id").withColumn(
        "rerank_score", scorer(F.col("question"), F.col("text"))
    )
    kept = rk.rerank_floor(scored, cfg.rerank_min)
    return rk.cut(rk.rerank_order(kept), cfg.top_k).drop("question", "text")


def corrective_search(
    chunks: DataFrame,
    questions: DataFrame,
    variants: DataFrame | None,
    cfg: Settings = Settings(),
    scorer: Scorer = overlap_score,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Grade, retry the poor ones with more phrasings, refuse the hopeless.

    ``variants`` has the shape of ``questions`` with ``variant_no`` > 0. A retry
    replaces the first attempt only where its best score is higher.
    """
    # Staged, because it is graded, kept and compared with the retry.
    first = reranked_search(chunks, questions, cfg, scorer, vectors)
    base = staged(first.withColumn("attempt", F.lit(1)))
    attempts = base
    if variants is not None:
        graded = rk.grade(questions, base, cfg.accept, cfg.reject)
        weak = graded.filter("verdict <> 'correct'").select("query_id")
        wider = staged(questions.unionByName(variants).join(weak, "query_id", "left_semi"))
        retry = reranked_search(chunks, wider, cfg, scorer, vectors).withColumn("attempt", F.lit(2))
        attempts = base.unionByName(retry)
    query = Window.partitionBy("query_id")
    best = F.max("rerank_score").over(Window.partitionBy("query_id", "attempt"))
    chosen = (
        attempts.withColumn("best", best)
        .withColumn("pick", F.max(F.struct(F.col("best"), -F.col("attempt"))).over(query))
        .filter(F.col("attempt") == -F.col("pick.col2"))
    )
    return chosen.filter(rk.verdict(F.col("best"), cfg.accept, cfg.reject) != "incorrect").drop("pick")


def citations(results: DataFrame) -> DataFrame:
    """Everything about where text came from, without the text."""
    wanted = (
        "query_id", "rank", "chunk_id", "filename", "page", "score", "section", "dense_score",
        "keyword_score", "matched_by", "rerank_score", "found_by_variant",
    )
    return results.select(*[c for c in wanted if c in results.columns])


def rendered_context(results: DataFrame) -> DataFrame:
    """``query_id, context``: labelled passages of a question in rank order."""
    block = F.concat(
        F.lit("Document: "), F.col("filename"), F.lit("\nPage: "), F.col("page").cast("string"),
        F.lit("\nContent: "), F.col("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return results.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["block"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_sources"),
    )


def answer_rows(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Every question gets a row: its context, or the fixed refusal."""
    contexts = rendered_context(results)
    return questions.select("query_id").distinct().join(contexts, "query_id", "left").select(
        "query_id",
        "context",
        F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"),
        F.when(F.col("context").isNull(), NO_ANSWER).alias("answer"),
    )


def search(
    chunks: DataFrame,
    questions: DataFrame,
    mode: str = "hybrid",
    rerank: bool = False,
    top_k: int = 5,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """The search as one function; register the result as a view for SQL users."""
    cfg = Settings(top_k=top_k, mode=mode)
    if rerank:
        return reranked_search(chunks, questions, cfg, vectors=vectors)
    return hybrid_search(chunks, questions, cfg, vectors=vectors)
