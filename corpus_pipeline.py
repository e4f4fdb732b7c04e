"""A training-data pipeline over the documents table.

Language identification (texts without a letter go), exact deduplication,
near-deduplication by SimHash and shingle sets (one document of each group stays), and packing into
sequences of 4096 tokens. Each stage works on what the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import with_small_batches
from corpusflow.llm.exact_dedup import exact_dedup, sha256
from corpusflow.llm.language_id import UNKNOWN, language_id, model_of
from corpusflow.llm.packing import pack
from corpusflow.llm.simhash import near_duplicates
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import prepare, staged

# No SQL can say hashes of shingles, learned languages or packings.
ORACLE_SQL = None

# Near copies: at least this Jaccard similarity of five-word shingles.
SIMILARITY = 0.8


def kept_rows(docs: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that ``decided(doc_id, key, kept)`` keeps; ``key`` is the key of a row of ``docs``.

    Rows that repeat an id and key stay once.
    """
    verdicts = staged(decided.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    named = verdicts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_same"), "kept", "n")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", key.alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_same"))
    rows = rows.join(broadcast_if_small(named.where("not kept")), same, "left_anti")
    repeated = named.where("kept and n > 1")
    if repeated.limit(1).count():
        again = broadcast_if_small(repeated)
        once = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "_key"])
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.select("_row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    with_small_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"))
    found = language_id(rows, model_of(docs), "_id", F.col("_row.text"))
    return found.where(F.col("lang_pred") != UNKNOWN).select("_row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    with_small_batches(spark)
    found = exact_dedup(docs.select("doc_id", "text"))
    return kept_rows(docs, found.select("doc_id", F.col("digest").alias("key"), "kept"), sha256(F.coalesce("text", F.lit(""))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    with_small_batches(spark)
    found = near_duplicates(docs.select("doc_id", "text"), similarity=SIMILARITY)
    return kept_rows(docs, found.select("doc_id", F.col("text_hash").alias("key"), "kept"), F.xxhash64(F.coalesce("text", F.lit(""))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    with_small_batches(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
