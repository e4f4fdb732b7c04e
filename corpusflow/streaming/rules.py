"""Frame and audio rules, observation parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.scalars import AUDIO_EXTENSIONS, AUDIO_MIME_TYPES, FRAME_MIME_TYPES, extension

# Fixed values ---------------------------------------------------------------
MAX_FRAME_MB = 5
MAX_AUDIO_MB = 25
OBSERVATION_FIELDS = (
    "objects", "text_detected", "ui_elements", "activities", "warnings", "important_changes"
)
NOTHING_SEEN = "(no notable observations)"
# End of fixed values --------------------------------------------------------


def _size_text(n_bytes: Column) -> Column:
    # Ties go to the even tenth: 156.25 MB reads 156.2. Java's format alone rounds them up.
    return F.format_string("%.1f", F.bround(n_bytes / (1024 * 1024), 1))


def frame_reason(session_id: Column, mime: Column, n_bytes: Column, max_mb: int = MAX_FRAME_MB) -> Column:
    """NULL for a valid frame, else the first rule it breaks."""
    return (
        F.when(tx.blank(session_id), "sessionId must not be empty.")
        .when(
            ~F.coalesce(mime, F.lit("")).isin(*FRAME_MIME_TYPES),
            F.concat(
                F.lit("Unsupported frame type '"), F.coalesce(F.nullif(mime, F.lit("")), F.lit("unknown")),
                F.lit("'. Supported types: " + ", ".join(sorted(FRAME_MIME_TYPES)) + "."),
            ),
        )
        .when(n_bytes == 0, "frame must not be empty.")
        .when(
            n_bytes > max_mb * 1024 * 1024,
            F.concat(
                F.lit("Frame is "), _size_text(n_bytes),
                F.lit(f"MB, which exceeds the {max_mb}MB limit for a single sampled frame."),
            ),
        )
    )


def audio_reason(filename: Column, mime: Column, n_bytes: Column, max_mb: int = MAX_AUDIO_MB) -> Column:
    """A known type or a known extension is enough; then emptiness, then size."""
    known = F.coalesce(mime, F.lit("")).isin(*AUDIO_MIME_TYPES) | extension(filename).isin(*AUDIO_EXTENSIONS)
    return (
        F.when(
            ~known,
            F.concat(
                F.lit("Unsupported audio file '"), filename, F.lit("' (type '"),
                F.coalesce(F.nullif(mime, F.lit("")), F.lit("unknown")),
                F.lit("'). Supported formats: mp3, wav, m4a, webm."),
            ),
        )
        .when(n_bytes == 0, F.concat(F.lit("'"), filename, F.lit("' is empty.")))
        .when(
            n_bytes > max_mb * 1024 * 1024,
            F.concat(
                F.lit("'"), filename, F.lit("' is "), _size_text(n_bytes),
                F.lit(f"MB, which exceeds the {max_mb}MB limit for audio uploads."),
            ),
        )
    )


def without_code_fence(reply: Column) -> Column:
    text = tx.strip(reply)
    opened = F.regexp_replace(text, r"\A```[^\n]*(?:\n|\z)", "")
    closed = F.regexp_replace(opened, rf"(?:\A|\n){tx.HORIZONTAL}*```{tx.HORIZONTAL}*\z", "")
    return F.when(text.startswith("```"), closed).otherwise(text)


def observations(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Model replies -> the six observed lists, a flat list and a summary line.

    A reply that is no JSON object becomes a raw-text observation.
    """
    schema = "struct<" + ", ".join(f"{name}: string" for name in OBSERVATION_FIELDS) + ">"
    parsed = F.from_json(without_code_fence(F.col(reply)), schema)
    raw = tx.strip(F.col(reply))
    lists = {}
    for name in OBSERVATION_FIELDS:
        items = F.from_json(F.col(f"_p.{name}"), "array<string>")
        is_list = F.col(f"_p.{name}").startswith("[")
        cleaned = F.filter(F.transform(items, tx.strip), lambda item: item != "")
        lists[name] = F.when(is_list, F.coalesce(cleaned, F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>")
        )
    out = replies.withColumn("_p", parsed).withColumns(lists).drop("_p")
    flat = F.concat(*[F.col(name) for name in OBSERVATION_FIELDS])
    summary = F.when(F.size("flat") > 0, F.array_join("flat", "; ")).when(F.col("raw_text") != "", F.col("raw_text"))
    return (
        out.withColumn("raw_text", raw)
        .withColumn("flat", flat)
        .withColumn("summary", F.coalesce(summary, F.lit(NOTHING_SEEN)))
    )
