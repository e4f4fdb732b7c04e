"""Conversation memory, archive and registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog import sqlparts as sp
from corpusflow.catalog.registry import Tables, query
from corpusflow.functions import scalars
from corpusflow.functions import text as tx
from corpusflow.operators import memory as me

WINDOW, TRIGGER = 3, 2
IN_FLIGHT_SQL = ", ".join(f"'{s}'" for s in me.IN_FLIGHT)


def messages(t: Tables) -> DataFrame:
    """Turns as messages; every third one carries an image or a recording."""
    turn, conv = F.col("turn"), F.col("conv_id")
    modality = F.when(turn % 3 == 0, F.when(conv % 2 == 0, "image").otherwise("audio")).otherwise("text")
    return t.conversations.select(
        "conv_id", (turn + 1).alias("msg_id"), "role", F.col("text").alias("content"), modality.alias("modality"),
        F.when(turn % 3 == 0, F.concat(F.lit("ref-"), ((conv * 7 + turn) % 11).cast("string"))).alias("attachment_ref"),
    )


MSG = """
messages AS (
  SELECT conv_id, turn + 1 AS msg_id, role, text AS content,
    CASE WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'image' ELSE 'audio' END ELSE 'text' END AS modality,
    CASE WHEN turn % 3 = 0 THEN 'ref-' || (conv_id * 7 + turn) % 11 END AS attachment_ref
  FROM conversations)"""
WIN = f"""{MSG},
win AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_id DESC) AS recency FROM messages QUALIFY recency <= {WINDOW})"""


@query(
    "message_content_guard",
    f"WITH {MSG} SELECT conv_id, msg_id, CASE WHEN {sp.strip('content')} = '' THEN 'content must not be empty' "
    "WHEN role NOT IN ('user', 'assistant') THEN 'role must be user or assistant' END AS reject_reason FROM messages",
)
def message_content_guard(t: Tables) -> DataFrame:
    return me.guard(messages(t)).select("conv_id", "msg_id", "reject_reason")


@query("history_window", f"WITH {WIN} SELECT conv_id, msg_id, role, content, recency FROM win")
def history_window(t: Tables) -> DataFrame:
    return me.history_window(messages(t), WINDOW).select("conv_id", "msg_id", "role", "content", "recency")


@query("full_history", f"WITH {MSG} SELECT conv_id, msg_id, role, content FROM messages")
def full_history(t: Tables) -> DataFrame:
    return me.full_history(messages(t)).select("conv_id", "msg_id", "role", "content")


def marks(t: Tables) -> DataFrame:
    return t.conversations.filter("conv_id % 3 = 0").select("conv_id").distinct().withColumn(
        "covered_through_id", F.lit(1).cast("bigint")
    )


SLICE = f"""{WIN},
bounds AS (
  SELECT conv_id, min(msg_id) AS oldest, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS mark FROM win GROUP BY 1 HAVING count(*) = {WINDOW}),
waiting AS (
  SELECT m.*, count(*) OVER (PARTITION BY conv_id) AS n_waiting, max(msg_id) OVER (PARTITION BY conv_id) AS new_mark
  FROM messages m JOIN bounds b USING (conv_id) WHERE msg_id < oldest AND msg_id > mark)"""


@query(
    "compaction_slice",
    f"WITH {SLICE} SELECT conv_id, msg_id, n_waiting, new_mark FROM waiting WHERE n_waiting >= {TRIGGER}",
)
def compaction_slice(t: Tables) -> DataFrame:
    waiting = me.compaction_slice(messages(t), marks(t), WINDOW, TRIGGER)
    return waiting.select("conv_id", "msg_id", "n_waiting", "new_mark")


def summaries(t: Tables) -> DataFrame:
    waiting = me.compaction_slice(messages(t), marks(t), WINDOW, TRIGGER)
    return waiting.groupBy("conv_id").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" earlier messages")).alias("summary"),
        F.max("msg_id").alias("covered_through_id"),
    )


SUMMARY = f"""{SLICE},
summaries AS (SELECT conv_id, count(*) || ' earlier messages' AS summary, max(msg_id) AS covered FROM waiting WHERE n_waiting >= {TRIGGER} GROUP BY 1),
prompt_rows AS (
  SELECT conv_id, -1 AS ord, 'system' AS role, '{me.SUMMARY_PREFIX}' || chr(10) || summary AS content FROM summaries
  UNION ALL SELECT conv_id, msg_id, role, content FROM win)"""


@query("summary_prefix_join", f"WITH {SUMMARY} SELECT conv_id, ord, role, content FROM prompt_rows")
def summary_prefix_join(t: Tables) -> DataFrame:
    return me.summary_and_window(messages(t), summaries(t), WINDOW)


@query(
    "summary_plus_window",
    f"""WITH {SUMMARY}
SELECT m.conv_id, m.msg_id, CASE WHEN m.msg_id <= s.covered THEN 1 ELSE 0 END AS in_summary,
  CASE WHEN w.msg_id IS NOT NULL THEN 1 ELSE 0 END AS in_window
FROM messages m JOIN summaries s USING (conv_id) LEFT JOIN win w ON w.conv_id = m.conv_id AND w.msg_id = m.msg_id""",
)
def summary_plus_window(t: Tables) -> DataFrame:
    rows = messages(t)
    window = me.history_window(rows, WINDOW).select("conv_id", "msg_id", F.lit(1).alias("in_window"))
    covered = rows.join(summaries(t), "conv_id")
    return covered.join(window, ["conv_id", "msg_id"], "left").select(
        "conv_id", "msg_id",
        (F.col("msg_id") <= F.col("covered_through_id")).cast("int").alias("in_summary"),
        F.coalesce("in_window", F.lit(0)).alias("in_window"),
    )


@query(
    "conversation_prompt_input",
    f"""WITH {SUMMARY},
asked AS (SELECT conv_id, 'question ' || conv_id AS q FROM conversations GROUP BY 1),
all_rows AS (SELECT * FROM prompt_rows UNION ALL SELECT conv_id, 4611686018427387904, 'user', q FROM asked)
SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY ord) AS prompt FROM all_rows GROUP BY 1""",
)
def conversation_prompt_input(t: Tables) -> DataFrame:
    asked = t.conversations.select("conv_id").distinct().withColumn(
        "question", F.concat(F.lit("question "), F.col("conv_id").cast("string"))
    )
    return me.prompt_input(messages(t), summaries(t), asked, WINDOW)


@query(
    "history_tail_render",
    f"""WITH {MSG}, tail AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY msg_id DESC) <= 4)
SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY msg_id) AS prompt FROM tail GROUP BY 1""",
)
def history_tail_render(t: Tables) -> DataFrame:
    return me.history_tail(messages(t))


ASOF = f"""{MSG},
as_of AS (
  SELECT *, last_value(CASE WHEN modality = 'image' THEN attachment_ref END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY msg_id ROWS UNBOUNDED PRECEDING) AS last_ref FROM messages)"""


@query("last_attachment_asof", f"WITH {ASOF} SELECT conv_id, msg_id, last_ref FROM as_of")
def last_attachment_asof(t: Tables) -> DataFrame:
    return me.last_attachment(messages(t), "image").select("conv_id", "msg_id", "last_ref")


@query(
    "image_turn_labels",
    f"""WITH {WIN},
cur AS (SELECT conv_id, arg_max(attachment_ref, msg_id) AS current_ref FROM messages WHERE modality = 'image' AND attachment_ref IS NOT NULL GROUP BY 1)
SELECT conv_id, msg_id, CASE WHEN modality = 'image' AND attachment_ref IS NOT NULL THEN
  '[' || CASE WHEN attachment_ref = current_ref THEN '{me.SAME_IMAGE}' ELSE '{me.OTHER_IMAGE}' END || '] ' || content ELSE content END AS content
FROM win JOIN cur USING (conv_id)""",
)
def image_turn_labels(t: Tables) -> DataFrame:
    rows = messages(t)
    current = (
        rows.filter("modality = 'image' AND attachment_ref IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.max_by("attachment_ref", "msg_id").alias("current_ref"))
    )
    return me.label_image_turns(me.history_window(rows, WINDOW), current).select("conv_id", "msg_id", "content")


@query(
    "media_turn_rows",
    f"""WITH ex AS (
  SELECT conv_id * 100 + turn AS exchange_id, conv_id, CASE WHEN turn % 2 = 0 THEN left(text, 30) END AS question,
    CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS transcript, 'about ' || left(text, 10) AS analysis, 'ref-' || turn AS ref FROM conversations),
u AS (SELECT *, coalesce(nullif(question, ''), '{me.DEFAULT_AUDIO_QUESTION}') AS asked,
  CASE WHEN length(transcript) > 200 THEN left(transcript, 200) || '... (transcript truncated; ' || length(transcript) || ' characters in full)' ELSE transcript END AS clipped FROM ex)
SELECT exchange_id, conv_id, 0 AS turn_no, 'user' AS role, CASE WHEN {sp.strip('transcript')} = '' THEN asked
  ELSE asked || chr(10) || chr(10) || '[Transcript of the attached audio: ' || clipped || ']' END AS content, 'audio' AS modality, ref AS attachment_ref FROM u
UNION ALL
SELECT exchange_id, conv_id, 1, 'assistant', CASE WHEN transcript = '' THEN '{me.NO_SPEECH}' ELSE analysis END, 'audio', ref FROM u""",
)
def media_turn_rows(t: Tables) -> DataFrame:
    turn = F.col("turn")
    exchanges = t.conversations.select(
        (F.col("conv_id") * 100 + turn).alias("exchange_id"), "conv_id",
        F.when(turn % 2 == 0, F.left("text", F.lit(30))).alias("question"),
        F.when(turn % 5 == 4, "").otherwise(F.col("text")).alias("transcript"),
        F.concat(F.lit("about "), F.left("text", F.lit(10))).alias("analysis"),
        F.concat(F.lit("ref-"), turn.cast("string")).alias("ref"),
    )
    return me.media_turns(exchanges, 200)


@query(
    "chat_titles",
    "WITH f AS (SELECT conv_id, arg_min({'r': role, 'c': text}, turn) AS m FROM conversations GROUP BY 1) "
    "SELECT conv_id, CASE WHEN m.r = 'user' THEN left(m.c, 48) ELSE 'New Chat' END AS title FROM f ORDER BY conv_id DESC LIMIT 50",
)
def chat_titles(t: Tables) -> DataFrame:
    return me.chat_titles(messages(t))


def archive(t: Tables) -> DataFrame:
    return messages(t).withColumn("created_order", F.col("conv_id") * 1000 + F.col("msg_id"))


@query(
    "message_search",
    f"WITH {MSG} SELECT conv_id, msg_id, content FROM messages WHERE contains(lower(content), 'the') "
    "ORDER BY conv_id * 1000 + msg_id DESC LIMIT 30",
)
def message_search(t: Tables) -> DataFrame:
    return me.message_search(archive(t), " The ").select("conv_id", "msg_id", "content")


@query(
    "search_snippet",
    f"""WITH {MSG}, p AS (SELECT *, instr(lower(content), 'st') - 1 AS pos0 FROM messages),
q AS (SELECT *, greatest(0, pos0 - 40) AS lo, least(length(content), pos0 + 2 + 40) AS hi FROM p)
SELECT conv_id, msg_id, CASE WHEN pos0 < 0 THEN left(content, 80) ELSE CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(content, lo + 1, hi - lo)
  || CASE WHEN hi < length(content) THEN '…' ELSE '' END END AS snippet FROM q""",
)
def search_snippet(t: Tables) -> DataFrame:
    return messages(t).select("conv_id", "msg_id", tx.snippet(F.col("content"), F.lit("st")).alias("snippet"))


STATUS = """
live AS (
  SELECT conv_id * 1000 + turn AS msg_id, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS content,
    CASE turn % 4 WHEN 1 THEN 'streaming' WHEN 3 THEN 'sending' ELSE 'done' END AS status FROM conversations)"""


def live(t: Tables) -> DataFrame:
    turn = F.col("turn")
    return t.conversations.select(
        (F.col("conv_id") * 1000 + turn).alias("msg_id"),
        F.when(turn % 4 == 3, "").otherwise(F.col("text")).alias("content"),
        F.when(turn % 4 == 1, "streaming").when(turn % 4 == 3, "sending").otherwise("done").alias("status"),
    )


@query(
    "settle_in_flight",
    f"WITH {STATUS} SELECT msg_id, CASE WHEN status IN ({IN_FLIGHT_SQL}) AND content = '' THEN '{me.INTERRUPTED}' ELSE content END AS content, "
    f"CASE WHEN status IN ({IN_FLIGHT_SQL}) THEN 'error' ELSE status END AS status FROM live",
)
def settle_in_flight(t: Tables) -> DataFrame:
    return me.settle_in_flight(live(t))


@query(
    "message_archive_upsert",
    f"""WITH {STATUS}, old AS (SELECT msg_id, content, status FROM live WHERE msg_id % 3 <> 0),
now AS (SELECT msg_id, CASE WHEN msg_id % 5 = 0 AND content <> '' THEN content || ' (edited)' ELSE content END AS content, status FROM live),
changed AS (SELECT n.* FROM now n LEFT JOIN old o ON o.msg_id = n.msg_id AND o.content = n.content AND o.status = n.status
  WHERE o.msg_id IS NULL AND {sp.strip('n.content')} <> '' AND n.status NOT IN ({IN_FLIGHT_SQL}))
SELECT msg_id, content, status FROM changed UNION ALL SELECT * FROM old WHERE msg_id NOT IN (SELECT msg_id FROM changed)""",
)
def message_archive_upsert(t: Tables) -> DataFrame:
    from corpusflow.sources.store import upsert

    before = live(t).filter("msg_id % 3 <> 0")
    edited = F.when((F.col("msg_id") % 5 == 0) & (F.col("content") != ""), F.concat("content", F.lit(" (edited)")))
    now = live(t).withColumn("content", F.coalesce(edited, F.col("content")))
    changed = me.archive_changes(before, now).withColumn("seq", F.lit(1))
    return upsert(before, changed, key="msg_id").select("msg_id", "content", "status")


@query(
    "delta_assembly",
    f"SELECT conv_id * 1000 + turn AS message_id, CASE WHEN turn % 3 = 2 THEN left(text, 40) ELSE text END AS content FROM conversations "
    f"WHERE {sp.strip('text')} <> '' AND turn % 7 <> 6",
)
def delta_assembly(t: Tables) -> DataFrame:
    body = F.when(F.col("turn") % 7 == 6, "  ").when(F.col("turn") % 3 == 2, F.left("text", F.lit(40))).otherwise(F.col("text"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("body") / 10).cast("int")), lambda i: F.substring(F.col("body"), i * 10 + 1, F.lit(10))
    )
    deltas = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), body.alias("body")).select(
        "message_id", F.posexplode(pieces).alias("seq", "delta")
    )
    return me.assemble_deltas(deltas)


@query(
    "thinking_strip",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || '<think>again' END AS content FROM conversations",
)
def thinking_strip(t: Tables) -> DataFrame:
    raw = F.when(
        F.col("turn") % 2 == 0, F.concat(F.lit("<think>a\nb</think>"), "text", F.lit("<think></think>"))
    ).otherwise(F.concat("text", F.lit("<think>again")))
    return t.conversations.select("conv_id", "turn", tx.strip_thinking(raw).alias("content"))


@query(
    "rewrite_guard",
    f"""WITH r AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'Here it is:' || chr(10) || chr(10) || ' "' || left(text, 50) || '" '
  WHEN 1 THEN '' WHEN 2 THEN repeat('x', 401) ELSE left(text, 60) END AS reply FROM conversations),
l AS (SELECT *, unnest(string_split(reply, chr(10))) AS line, generate_subscripts(string_split(reply, chr(10)), 1) AS n FROM r),
c AS (SELECT *, {sp.strip("regexp_replace(regexp_replace(" + sp.strip('line') + ", '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")} AS s FROM l),
f AS (SELECT conv_id, turn, arg_min(s, n) AS s FROM c WHERE s <> '' AND s NOT LIKE '%:' GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN length(s) <= 400 THEN s ELSE text END AS question FROM r LEFT JOIN f USING (conv_id, turn)""",
)
def rewrite_guard(t: Tables) -> DataFrame:
    turn = F.col("turn")
    reply = (
        F.when(turn % 4 == 0, F.concat(F.lit('Here it is:\n\n "'), F.left("text", F.lit(50)), F.lit('" ')))
        .when(turn % 4 == 1, "")
        .when(turn % 4 == 2, "x" * 401)
        .otherwise(F.left("text", F.lit(60)))
    )
    return t.conversations.select("conv_id", "turn", scalars.rewrite_or_original(reply, F.col("text")).alias("question"))


@query(
    "text_clip",
    f"SELECT doc_id, CASE WHEN length(text) > 700 THEN regexp_replace(left(text, 700), '{sp.SPACE}+$', '') || ' […]' ELSE text END AS text FROM documents",
)
def text_clip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clip(F.col("text"), 700, " […]").alias("text"))
