"""Views of the supplied tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog.registry import Tables
from corpusflow.operators.replies import clean_variants


def chunks(t: Tables) -> DataFrame:
    """Every document as one chunk."""
    return t.documents.select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.col("source").alias("parent_id"),
        F.concat("source", F.lit(".txt")).alias("filename"),
        (F.col("doc_id") % 7 + 1).alias("page"),
        F.col("lang").alias("section"),
    )


def vectors(t: Tables) -> DataFrame:
    """Vectors of the chunks, aligned by id and stored apart from the text."""
    ids = t.documents.select(F.col("doc_id").alias("chunk_id"))
    stored = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return stored.join(ids, "chunk_id", "left_semi")


def dense_chunks(t: Tables) -> DataFrame:
    """Chunks with their vectors in one table, as a filtered search needs."""
    return chunks(t).join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


def questions(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding")
    return t.benchmark.join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.lit(0).alias("variant_no"), "text", "embedding"
    )


def replies(t: Tables) -> DataFrame:
    """Model replies to 'rephrase this question', built from the question."""
    text = F.col("text")
    head = F.left(text, F.lit(60))
    return t.benchmark.select(
        F.col("item_id").alias("query_id"),
        text.alias("question"),
        F.concat(
            F.lit("1. "), head, F.lit("\n- "), F.right(text, F.lit(60)), F.lit("\n* "), F.upper(head),
            F.lit("\n"), text, F.lit("\n2) "), F.substring(text, 31, 60),
        ).alias("reply"),
    )


def variants(t: Tables) -> DataFrame:
    cleaned = clean_variants(replies(t), 2).withColumn(
        "vec_id", F.col("query_id") + F.col("variant_no") * 40
    )
    return cleaned.join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left").select(
        "query_id", "variant_no", "text", "embedding"
    )


def phrasings(t: Tables) -> DataFrame:
    return questions(t).unionByName(variants(t))
