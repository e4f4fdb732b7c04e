"""Cleaning of model replies that arrive as tables: rewrites and propositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.models import CHARACTERS, Measure

MAX_VARIANT_CHARS = 300
MIN_PROPOSITION_CHARS = 20
MAX_PROPOSITIONS = 20
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def without_marker(line: Column) -> Column:
    """Remove a leading bullet or number that a model added."""
    text = F.regexp_replace(tx.strip(line), "^[-*• \t]+", "")
    return tx.strip(F.regexp_replace(text, r"^\p{Nd}+[.):]", ""))


def phrasing_key(text: Column) -> Column:
    """Letters, digits and single characters of space, lower-cased."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", ""))


def reply_lines(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.select(
        *[c for c in replies.columns if c != reply],
        F.posexplode(F.split(F.coalesce(F.col(reply), F.lit("")), LINE_BREAK)).alias("line_no", "line"),
    )


def clean_variants(replies: DataFrame, count: int = 3) -> DataFrame:
    """``query_id, variant_no, text``: usable, distinct, first ``count``.

    ``replies`` has ``query_id, question, reply``. A phrasing equal to the
    question or to an earlier phrasing is dropped.
    """
    lines = reply_lines(replies).select(
        "query_id",
        "line_no",
        without_marker(F.col("line")).alias("text"),
        phrasing_key(F.col("question")).alias("own_key"),
    )
    usable = lines.filter((F.col("text") != "") & (F.length("text") <= MAX_VARIANT_CHARS))
    keyed = usable.withColumn("key", phrasing_key(F.col("text"))).filter(F.col("key") != F.col("own_key"))
    first = keyed.groupBy("query_id", "key").agg(F.min(F.struct("line_no", "text")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first.line_no")
    return (
        first.withColumn("variant_no", F.row_number().over(order))
        .filter(F.col("variant_no") <= count)
        .select("query_id", "variant_no", F.col("first.text").alias("text"))
    )


def clean_propositions(
    replies: DataFrame, size: Column | int = 256, measure: Measure = CHARACTERS, cap: int = MAX_PROPOSITIONS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``passage_id, prop_no, proposition`` and the columns to ``keep``; the cap is the feature's own."""
    cleaned = reply_lines(replies).withColumn(
        "proposition",
        tx.strip(F.regexp_replace(tx.strip(F.col("line")), "^[-*•0-9.) ]+", "")),
    )
    kept = cleaned.filter(
        (F.length("proposition") >= MIN_PROPOSITION_CHARS)
        & (measure.count(F.col("proposition")) <= size)
    )
    order = Window.partitionBy("passage_id").orderBy("line_no")
    return (
        kept.withColumn("prop_no", F.row_number().over(order))
        .filter(F.col("prop_no") <= cap)
        .select("passage_id", "prop_no", "proposition", *keep)
    )
