"""Conversation memory over tables of messages.

``messages``: ``conv_id, msg_id, role, content`` and optionally ``modality``,
``attachment_ref``. ``msg_id`` grows within a conversation. Windows that are
cut to the last N rows use the group-limit form; anything that must look at a
whole conversation goes through ``ordered``, so one huge conversation is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.keyword import require_positive
from corpusflow.operators.ordered import last_known

# Fixed values ---------------------------------------------------------------
ROLES = ("user", "assistant")
HISTORY_LIMIT = 20
COMPACTION_TRIGGER = 10
CONTEXTUALIZE_TURNS = 4
TRANSCRIPT_CHARS = 4000
MAX_CHATS = 50
TITLE_CHARS = 48
SEARCH_LIMIT = 30
MIN_QUERY_CHARS = 2
SUMMARY_PREFIX = "Summary of earlier turns in this conversation:"
DEFAULT_AUDIO_QUESTION = "Summarise this audio."
NO_SPEECH = "No speech was detected in this audio file, so no analysis could be generated."
IN_FLIGHT = ("sending", "streaming", "searching", "generating", "transcribing", "analyzing")
INTERRUPTED = "This response was interrupted by a page reload. Please ask again."
SAME_IMAGE = "about the image in this message"
OTHER_IMAGE = "about a DIFFERENT image, not the one attached now"
# End of fixed values --------------------------------------------------------

BUCKET_ROWS = 1000


def guard(messages: DataFrame) -> DataFrame:
    """Add ``reject_reason``: blank content or a role outside user/assistant."""
    reason = F.when(tx.blank(F.col("content")), "content must not be empty").when(
        ~F.col("role").isin(*ROLES), "role must be user or assistant"
    )
    return messages.withColumn("reject_reason", reason)


def history_window(messages: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The most recent ``limit`` messages per conversation, with ``recency``."""
    require_positive(limit=limit)
    newest = Window.partitionBy("conv_id").orderBy(F.col("msg_id").desc())
    return messages.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= limit)


def full_history(messages: DataFrame) -> DataFrame:
    return messages.orderBy("conv_id", "msg_id")


def compaction_slice(
    messages: DataFrame, marks: DataFrame, limit: int = HISTORY_LIMIT, trigger: int = COMPACTION_TRIGGER
) -> DataFrame:
    """Messages that fell out of the window and are not summarised yet.

    ``marks``: ``conv_id, covered_through_id``. A conversation qualifies when
    its window is full and at least ``trigger`` messages wait. Adds
    ``new_mark``, the id the next summary will cover through.
    """
    window = history_window(messages, limit).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_window"), F.min("msg_id").alias("oldest")
    )
    bounds = window.filter(F.col("n_window") == limit).join(marks, "conv_id", "left")
    waiting = messages.join(bounds, "conv_id").filter(
        (F.col("msg_id") < F.col("oldest"))
        & (F.col("msg_id") > F.coalesce("covered_through_id", F.lit(0)))
    )
    enough = waiting.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_waiting"), F.max("msg_id").alias("new_mark")
    ).filter(F.col("n_waiting") >= trigger)
    return waiting.join(enough, "conv_id").select(*messages.columns, "n_waiting", "new_mark")


def summary_and_window(messages: DataFrame, summaries: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Summary row (if any) in front of the window: ``conv_id, ord, role, content``.

    ``summaries``: ``conv_id, summary, covered_through_id``.
    """
    window = history_window(messages, limit).select(
        "conv_id", F.col("msg_id").alias("ord"), "role", "content"
    )
    prefix = summaries.select(
        "conv_id",
        F.lit(-1).cast("bigint").alias("ord"),
        F.lit("system").alias("role"),
        F.concat(F.lit(SUMMARY_PREFIX + "\n"), F.col("summary")).alias("content"),
    )
    return prefix.unionByName(window)


def prompt_input(messages: DataFrame, summaries: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """Summary, last turns and current question as one ordered text per conversation."""
    rows = summary_and_window(messages, summaries, limit).join(
        questions.select("conv_id"), "conv_id", "left_semi"
    )
    now = questions.select(
        "conv_id", F.lit(2**62).cast("bigint").alias("ord"), F.lit("user").alias("role"), F.col("question").alias("content")
    )
    return render_turns(rows.unionByName(now), "ord")


def render_turns(rows: DataFrame, order: str) -> DataFrame:
    """``conv_id, prompt``: one ``role: content`` line per turn of a bounded window."""
    turn = F.struct(F.col(order), F.concat("role", F.lit(": "), "content").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(turn)), lambda r: r["line"])
    return rows.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("prompt"))


def history_tail(messages: DataFrame, turns: int = CONTEXTUALIZE_TURNS) -> DataFrame:
    return render_turns(history_window(messages, turns), "msg_id")


def last_attachment(messages: DataFrame, modality: str, name: str = "last_ref") -> DataFrame:
    """As of every message: the latest reference of ``modality`` so far."""
    ref = F.when(F.col("modality") == modality, F.col("attachment_ref"))
    return last_known(
        messages, ["conv_id"], [F.col("msg_id")], F.floor(F.col("msg_id") / BUCKET_ROWS), ref, name
    )


def label_image_turns(window: DataFrame, current: DataFrame) -> DataFrame:
    """Say of every image turn whether it is about the image attached now.

    ``current``: ``conv_id, current_ref``.
    """
    labelled = window.join(current, "conv_id")
    label = F.when(F.col("attachment_ref") == F.col("current_ref"), SAME_IMAGE).otherwise(OTHER_IMAGE)
    image = (F.col("modality") == "image") & F.col("attachment_ref").isNotNull()
    return labelled.withColumn(
        "content",
        F.when(image, F.concat(F.lit("["), label, F.lit("] "), F.col("content"))).otherwise(F.col("content")),
    )


def media_turns(exchanges: DataFrame, limit: int = TRANSCRIPT_CHARS) -> DataFrame:
    """One audio exchange -> user turn with its transcript and assistant turn.

    ``exchanges``: ``exchange_id, conv_id, question, transcript, analysis, ref``.
    """
    transcript = F.col("transcript")
    clipped = F.when(
        F.length(transcript) > limit,
        F.concat(
            F.left(transcript, F.lit(limit)), F.lit("... (transcript truncated; "),
            F.length(transcript).cast("string"), F.lit(" characters in full)"),
        ),
    ).otherwise(transcript)
    asked = F.coalesce(F.nullif(F.col("question"), F.lit("")), F.lit(DEFAULT_AUDIO_QUESTION))
    user = F.when(tx.blank(transcript), asked).otherwise(
        F.concat(asked, F.lit("\n\n[Transcript of the attached audio: "), clipped, F.lit("]"))
    )
    answer = F.when(F.coalesce(transcript, F.lit("")) == "", NO_SPEECH).otherwise(F.col("analysis"))

    def turn(no: int, role: str, content: Column) -> Column:
        return F.struct(F.lit(no).alias("turn_no"), F.lit(role).alias("role"), content.alias("content"))

    rows = F.explode(F.array(turn(0, "user", user), turn(1, "assistant", answer))).alias("t")
    return exchanges.select(
        "exchange_id", "conv_id", rows, F.lit("audio").alias("modality"), F.col("ref").alias("attachment_ref")
    ).select("exchange_id", "conv_id", "t.*", "modality", "attachment_ref")


def chat_titles(messages: DataFrame, keep: int = MAX_CHATS) -> DataFrame:
    """Title from a user's opening message; the newest ``keep`` chats."""
    first = messages.groupBy("conv_id").agg(F.min_by(F.struct("role", "content"), "msg_id").alias("m"))
    title = F.when(F.col("m.role") == "user", F.left("m.content", F.lit(TITLE_CHARS))).otherwise("New Chat")
    return first.select("conv_id", title.alias("title")).orderBy(F.col("conv_id").desc()).limit(keep)


def message_search(messages: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Newest messages containing ``query``, whatever the case."""
    needle = query.strip().lower()
    if len(needle) < MIN_QUERY_CHARS:
        return messages.limit(0)
    hits = messages.filter(F.contains(F.lower("content"), F.lit(needle)))
    return hits.orderBy(F.col("created_order").desc()).limit(limit)


def settle_in_flight(messages: DataFrame) -> DataFrame:
    """A message still in flight at reload becomes an error with a notice."""
    flying = F.col("status").isin(*IN_FLIGHT)
    content = F.when(flying & (F.coalesce("content", F.lit("")) == ""), INTERRUPTED).otherwise(F.col("content"))
    status = F.when(flying, "error").otherwise(F.col("status"))
    return messages.withColumns({"content": content, "status": status})


def archive_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """New or edited messages worth archiving; blank and in-flight ones are not."""
    digest = F.xxhash64("content", "status")
    old = before.select("msg_id", digest.alias("digest"))
    changed = now.withColumn("digest", digest).join(old, ["msg_id", "digest"], "left_anti").drop("digest")
    return changed.filter(~tx.blank(F.col("content")) & ~F.col("status").isin(*IN_FLIGHT))


def assemble_deltas(deltas: DataFrame) -> DataFrame:
    """``message_id, content``: streamed pieces in order; empty messages vanish."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    joined = deltas.groupBy("message_id").agg(
        F.array_join(F.transform(ordered, lambda d: d["delta"]), "").alias("content")
    )
    return joined.filter(~tx.blank(F.col("content")))
