"""Frame sessions, streams and incremental stores over events and documents."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog import sqlparts as sp
from corpusflow.catalog.conversation import TRIGGER, WINDOW, messages
from corpusflow.catalog.registry import Tables, query
from corpusflow.functions.scalars import FRAME_MIME_TYPES
from corpusflow.plans.ingest import ingest, remove_documents, search_stored
from corpusflow.session import shared_dir, staged
from corpusflow.sources import store as st
from corpusflow.streaming import frames as fr
from corpusflow.streaming import rules
from corpusflow.streaming.ingest import compaction_stream, ingest_stream
from corpusflow.streaming.sinks import read_file_stream, run_counting_late, run_to_files

INTERVAL = 6 * 3600.0
TTL = 8 * 3600.0
EVERY = 3
SECONDS = "epoch_us(ts) / 1e6::DOUBLE"
MIMES = (*FRAME_MIME_TYPES, "image/gif")


def as_frames(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("frame_id"),
        ts.alias("ts"),
        (F.unix_micros(ts) / 1e6).alias("t"),
        "event_type",
        F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("summary"),
    )


def frames(t: Tables) -> DataFrame:
    return as_frames(t.events)


def frames_stream(t: Tables) -> DataFrame:
    schema = t.spark.read.parquet(t.path("events")).schema
    stream = as_frames(read_file_stream(t.spark, t.folder, "events.parquet", schema))
    return stream.withColumns({"valid": F.lit(True), "is_end": F.lit(False)})


FRAMES = f"""
frames AS (
  SELECT user_id AS session_id, event_id AS frame_id, {SECONDS} AS t, event_type, event_type || ' ' || json_extract_string(props, '$.k') AS summary FROM events)"""


@query(
    "frame_validation",
    """WITH f AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '  ' ELSE user_id::VARCHAR END AS sid,
    ['image/jpeg', 'image/jpg', 'image/png', 'image/webp', 'image/gif'][event_id % 5 + 1] AS mime, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (value * 1000000)::BIGINT END AS n FROM events)
SELECT event_id, CASE WHEN trim(sid) = '' THEN 'sessionId must not be empty.'
  WHEN mime = 'image/gif' THEN 'Unsupported frame type ''image/gif''. Supported types: image/jpeg, image/jpg, image/png, image/webp.'
  WHEN n = 0 THEN 'frame must not be empty.' WHEN n > 5242880 THEN printf('Frame is %.1fMB, which exceeds the 5MB limit for a single sampled frame.', n / 1048576.0) END AS reject_reason FROM f""",
)
def frame_validation(t: Tables) -> DataFrame:
    number = F.col("event_id")
    session = F.when(number % 9 == 0, "  ").otherwise(F.col("user_id").cast("string"))
    mime = F.element_at(F.array(*[F.lit(m) for m in MIMES]), (number % 5 + 1).cast("int"))
    size = F.when(number % 7 == 0, 0).otherwise(F.round(F.col("value") * 1_000_000).cast("bigint"))
    return t.events.select("event_id", rules.frame_reason(session, mime, size).alias("reject_reason"))


@query(
    "audio_validation",
    """WITH f AS (SELECT event_id, ['a.MP3', 'b.txt', 'c', 'd.webm'][event_id % 4 + 1] AS filename,
    ['audio/mpeg', 'text/plain', '', 'audio/x-m4a', 'video/mp4'][event_id % 5 + 1] AS mime, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1000 END AS n FROM events)
SELECT event_id, CASE WHEN mime NOT IN ('audio/mpeg', 'audio/x-m4a') AND filename NOT IN ('a.MP3', 'd.webm')
  THEN 'Unsupported audio file ''' || filename || ''' (type ''' || CASE WHEN mime = '' THEN 'unknown' ELSE mime END || '''). Supported formats: mp3, wav, m4a, webm.'
  WHEN n = 0 THEN '''' || filename || ''' is empty.' END AS reject_reason FROM f""",
)
def audio_validation(t: Tables) -> DataFrame:
    number = F.col("event_id")

    def pick(values: list[str]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))

    name = pick(["a.MP3", "b.txt", "c", "d.webm"])
    mime = pick(["audio/mpeg", "text/plain", "", "audio/x-m4a", "video/mp4"])
    size = F.when(number % 7 == 0, 0).otherwise(1000)
    return t.events.select("event_id", rules.audio_reason(name, mime, size).alias("reject_reason"))


OBS_SQL = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '; ' || json_extract_string(props, '$.k') || '; hot'
  WHEN event_id % 3 = 1 THEN '(no notable observations)' ELSE 'just ' || event_type END AS summary,
  CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS n_observed FROM events"""


@query("observation_parse", OBS_SQL.replace("WHEN event_id % 3 = 1 THEN '(no notable observations)'", "WHEN event_id % 3 = 1 THEN ''").replace(
    "'' ELSE 'just '", "'{\"objects\": \"none\"}' ELSE 'just '"))
def observation_parse(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    reply = (
        F.when(
            F.col("event_id") % 3 == 0,
            F.concat(
                F.lit('```json\n{"objects": [" '), "event_type", F.lit('", ""], "warnings": ["hot"], "text_detected": ['), k, F.lit("]}\n```"),
            ),
        )
        .when(F.col("event_id") % 3 == 1, '{"objects": "none"}')
        .otherwise(F.concat(F.lit("  just "), "event_type"))
    )
    parsed = rules.observations(t.events.select("event_id", reply.alias("reply")))
    return parsed.select("event_id", "summary", F.size("flat").alias("n_observed"))


SAMPLED = f"""{FRAMES},
sampled AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_id) AS n FROM frames QUALIFY (n - 1) % {EVERY} = 0)"""


@query("frame_count_sample", f"WITH {SAMPLED} SELECT session_id, frame_id FROM sampled")
def frame_count_sample(t: Tables) -> DataFrame:
    return fr.frame_count_sample(frames(t), EVERY).select("session_id", "frame_id")


@query(
    "recent_context",
    f"""WITH {SAMPLED},
held AS (SELECT session_id, frame_id, list(summary) OVER (PARTITION BY session_id ORDER BY t, frame_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM sampled)
SELECT session_id, frame_id, coalesce(array_to_string(list_transform(h, lambda s, i: 'Frame ' || i || ': ' || s), chr(10)), '') AS context FROM held""",
)
def recent_context(t: Tables) -> DataFrame:
    kept = fr.frame_count_sample(frames(t), EVERY)
    return fr.recent_context(kept).select("session_id", "frame_id", "context")


GREEDY = f"""{FRAMES},
ordered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, frame_id) AS n FROM frames),
walk AS (
  SELECT session_id, n, frame_id, t AS last_kept, true AS kept FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.n, o.frame_id, CASE WHEN o.t - w.last_kept >= {INTERVAL} THEN o.t ELSE w.last_kept END, o.t - w.last_kept >= {INTERVAL}
  FROM walk w JOIN ordered o ON o.session_id = w.session_id AND o.n = w.n + 1)"""


@query("interval_sample", f"WITH RECURSIVE {GREEDY} SELECT session_id, frame_id FROM walk WHERE kept")
def interval_sample(t: Tables) -> DataFrame:
    return fr.interval_sample(frames(t), INTERVAL).select("session_id", "frame_id")


GAPS = f"""{FRAMES},
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER w > {TTL} THEN 1 ELSE 0 END AS o FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t, frame_id)),
sessions AS (SELECT *, (sum(o) OVER (PARTITION BY session_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM gaps)"""


@query(
    "session_expiry",
    f"WITH {GAPS} SELECT session_id, session_no, count(*) AS n_frames, min(frame_id) AS first_frame FROM sessions GROUP BY 1, 2",
)
def session_expiry(t: Tables) -> DataFrame:
    sessions = fr.sessions_by_gap(frames(t), TTL)
    return sessions.groupBy("session_id", "session_no").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame_id").alias("first_frame")
    )


ENDED = f"""{FRAMES},
epochs AS (SELECT *, (sum((event_type = 'error')::INT) OVER (PARTITION BY session_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) - (event_type = 'error')::INT)::BIGINT AS epoch FROM frames),
after_end AS (SELECT *, row_number() OVER (PARTITION BY session_id, epoch ORDER BY t, frame_id) AS n FROM epochs WHERE event_type <> 'error')"""


@query(
    "explicit_session_end",
    f"WITH {ENDED} SELECT session_id, epoch, frame_id FROM after_end WHERE (n - 1) % {EVERY} = 0",
)
def explicit_session_end(t: Tables) -> DataFrame:
    marked = frames(t).withColumn("is_end", F.col("event_type") == "error")
    live = fr.sessions_by_end(marked).filter(~F.col("is_end"))
    return fr.frame_count_sample(live, EVERY, ("session_id", "epoch")).select("session_id", "epoch", "frame_id")


@query(
    "session_stats",
    f"""WITH {FRAMES}, v AS (SELECT * FROM frames WHERE event_type <> 'error'),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, frame_id) < 300 THEN 0 ELSE 1 END AS o FROM v),
s AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT session_id, min(frame_id) AS first_frame, count(*) AS n_frames, count(*) FILTER (frame_id % 2 = 0) AS n_sampled FROM s GROUP BY session_id, no""",
)
def session_stats(t: Tables) -> DataFrame:
    valid = frames(t).filter(F.col("event_type") != "error")
    return (
        valid.groupBy("session_id", F.session_window("ts", "300 seconds"))
        .agg(
            F.min("frame_id").alias("first_frame"), F.count(F.lit(1)).alias("n_frames"),
            F.count_if(F.col("frame_id") % 2 == 0).alias("n_sampled"),
        )
        .drop("session_window")
    )


# Structured Streaming ----------------------------------------------------------


@query("event_file_stream", f"WITH {FRAMES} SELECT session_id, frame_id, t, event_type, summary FROM frames")
def event_file_stream(t: Tables) -> DataFrame:
    return run_to_files(frames_stream(t)).select("session_id", "frame_id", "t", "event_type", "summary")


# Frames reach the stream up to an hour late and out of order, in slices by arrival.
DISORDER = 3600.0
SLICES = 3
FILES_PER_BATCH = 4


def shuffled_stream(t: Tables, ends: str | None = None, invalid: str | None = None) -> tuple[DataFrame, str]:
    """All frames in order of a disturbed arrival time, and the delay that covers the disorder.

    Two heartbeats at the end move the watermark past everything. ``ends`` and
    ``invalid`` name the event types that end a session or are no valid frame.
    Files of one slice may be read in any order, so the delay spans a slice.
    """
    folder = f"{shared_dir(t.spark)}/corpusflow-arrivals/{uuid.uuid4().hex}"
    kind = F.col("event_type")
    rows = frames(t).withColumns({"valid": kind != F.lit(invalid or ""), "is_end": kind == F.lit(ends or "")})
    arrival = F.col("t") + F.pmod(F.xxhash64("frame_id"), F.lit(int(DISORDER)))
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    low, high = low or 0.0, high or 0.0
    width = (high - low) / SLICES or 1.0
    number = F.least(F.floor((arrival - low) / width), F.lit(SLICES - 1))
    for n in range(SLICES):
        rows.filter(number == n).write.mode("append").parquet(folder)
    after = high + width + DISORDER + 2 * TTL
    beat = (F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.timestamp_seconds(F.lit(after)), F.lit(after),
            F.lit("heartbeat"), F.lit(""), F.lit(False), F.lit(False))
    for _ in range(2):
        t.spark.range(1).select(*(c.alias(name) for c, name in zip(beat, rows.columns))).write.mode("append").parquet(folder)
    stream = read_file_stream(t.spark, folder, "*.parquet", rows.schema, FILES_PER_BATCH)
    return stream, f"{math.ceil(width + DISORDER)} seconds"


def stateful(t: Tables, processor: fr.FrameSessions, ends: str | None = None) -> DataFrame:
    stream, delay = shuffled_stream(t, ends)
    out, late = run_counting_late(fr.frame_stream(stream, processor, delay))
    if late:
        raise RuntimeError(f"{late} frames came more than {delay} late")
    return out


@query("interval_sample_stream", f"WITH RECURSIVE {GREEDY} SELECT session_id, frame_id FROM walk WHERE kept")
def interval_sample_stream(t: Tables) -> DataFrame:
    return stateful(t, fr.FrameSessions("interval", INTERVAL, ttl=None)).filter("sampled").select("session_id", "frame_id")


@query("frame_count_sample_stream", f"WITH {SAMPLED} SELECT session_id, frame_id FROM sampled")
def frame_count_sample_stream(t: Tables) -> DataFrame:
    return stateful(t, fr.FrameSessions("frame_count", every=EVERY, ttl=None)).filter("sampled").select("session_id", "frame_id")


@query(
    "session_context_stream",
    f"""WITH {GAPS},
kept AS (SELECT *, row_number() OVER (PARTITION BY session_id, session_no ORDER BY t, frame_id) AS n FROM sessions QUALIFY (n - 1) % {EVERY} = 0),
held AS (SELECT session_id, frame_id, list(summary) OVER (PARTITION BY session_id, session_no ORDER BY t, frame_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM kept)
SELECT session_id, frame_id, coalesce(array_to_string(list_transform(h, lambda s, i: 'Frame ' || i || ': ' || s), chr(10)), '') AS context FROM held""",
)
def session_context_stream(t: Tables) -> DataFrame:
    out = stateful(t, fr.FrameSessions("frame_count", every=EVERY, ttl=TTL))
    return out.filter("sampled").select("session_id", "frame_id", "context")


@query(
    "session_end_stream",
    f"WITH {ENDED} SELECT session_id, frame_id FROM after_end WHERE (n - 1) % {EVERY} = 0",
)
def session_end_stream(t: Tables) -> DataFrame:
    out = stateful(t, fr.FrameSessions("frame_count", every=EVERY, ttl=None), ends="error")
    return out.filter("sampled").select("session_id", "frame_id")


@query(
    "session_stats_stream",
    f"""WITH {FRAMES}, v AS (SELECT * FROM frames WHERE event_type <> 'error'),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, frame_id) < 300 THEN 0 ELSE 1 END AS o FROM v),
s AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT session_id, min(t) AS start, count(*) AS n_frames, count(*) FILTER (frame_id % 2 = 0) AS n_sampled FROM s GROUP BY session_id, no""",
)
def session_stats_stream(t: Tables) -> DataFrame:
    stream, delay = shuffled_stream(t, invalid="error")
    stats = run_to_files(fr.session_stats_stream(stream.withColumn("sampled", F.col("frame_id") % 2 == 0), delay=delay))
    return stats.select("session_id", (F.unix_micros("w.start") / 1e6).alias("start"), "n_frames", "n_sampled")


@query("compaction_stream")
def compaction_stream_marks(t: Tables) -> DataFrame:
    base = f"{shared_dir(t.spark)}/corpusflow-compaction/{uuid.uuid4().hex}"
    rows = messages(t)
    for part in ("msg_id <= 4", "msg_id > 4"):  # the second run goes on where the first ended
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        compaction_stream(read_file_stream(t.spark, f"{base}/in", "*.parquet", rows.schema), base, WINDOW, TRIGGER)
    return st.read_store(t.spark, f"{base}/marks", "conv_id")


def files_of(t: Tables) -> DataFrame:
    """Documents as text files and pages as HTML files in one table."""
    docs = t.documents.select(
        F.col("doc_id").alias("doc_id"),
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".exe")))
        .otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")))
        .alias("filename"),
        F.when(F.col("doc_id") % 23 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("text"),
    )
    pages = t.pages.select(
        (F.col("page_id") + 10_000_000).alias("doc_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.col("html").alias("text"),
    )
    return docs.unionByName(pages).withColumn("n_bytes", F.octet_length("text").cast("bigint"))


INGEST_SQL = """
WITH files AS (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'exe' ELSE 'txt' END AS ext, CASE WHEN doc_id % 23 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM documents
  UNION ALL SELECT page_id + 10000000, 'html', html FROM pages),
canon AS (SELECT text, min(doc_id) AS c FROM files WHERE ext <> 'exe' GROUP BY 1)
SELECT doc_id, CASE WHEN ext = 'exe' THEN 'REJECTED' WHEN c <> doc_id THEN 'DUPLICATE' WHEN length(trim(replace(f.text, chr(10), ' '))) = 0 THEN 'FAILED' ELSE 'READY' END AS status,
  CASE WHEN ext <> 'exe' AND c <> doc_id THEN c END AS duplicate_of,
  CASE WHEN ext = 'exe' THEN 'Unsupported file type ''.exe''.' WHEN c = doc_id AND length(trim(replace(f.text, chr(10), ' '))) = 0
    THEN 'No text could be extracted: the pages appear to contain no words.' END AS failure_reason
FROM files f LEFT JOIN canon USING (text)"""


@query("ingest_corpus", INGEST_SQL)
def ingest_corpus(t: Tables) -> DataFrame:
    _, registry = ingest(files_of(t), size=1000, overlap=200)
    return registry.select("doc_id", "status", "duplicate_of", "failure_reason")


@query("incremental_ingest", INGEST_SQL)
def incremental_ingest(t: Tables) -> DataFrame:
    base = f"{shared_dir(t.spark)}/corpusflow-ingest/{uuid.uuid4().hex}"
    files = files_of(t)
    for part in (1, 0):  # the second run goes on where the first ended
        files.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        ingest_stream(read_file_stream(t.spark, f"{base}/in", "*.parquet", files.schema), base, size=1000, overlap=200)
    return st.read_store(t.spark, f"{base}/registry", "doc_id").select("doc_id", "status", "duplicate_of", "failure_reason")


# Every text is one chunk here, so that SQL can say what is searched.
WHOLE = 10**9
FIRST_CHUNK = "p1::c0"


def stored_search_sql(which: str) -> str:
    """Best questions' hits over the first document of every text among ``which`` documents."""
    chunks = f"chunks AS (SELECT min(doc_id)::VARCHAR || '::{FIRST_CHUNK}' AS chunk_id, text FROM documents WHERE {which} GROUP BY text)"
    return f"SELECT * FROM (WITH {chunks},{sp.QUESTIONS},{sp.keyword(20)} SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, rank FROM kw)"


@query(
    "indexed_search",
    f"SELECT 'all' AS held, * FROM ({stored_search_sql('true')}) UNION ALL SELECT 'kept' AS held, * FROM ({stored_search_sql('doc_id % 11 <> 0')})",
)
def indexed_search(t: Tables) -> DataFrame:
    """All questions against the stored postings of a stream of documents, then again after a delete."""
    base = f"{shared_dir(t.spark)}/corpusflow-ingest/{uuid.uuid4().hex}"
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = t.documents.select("doc_id", name.alias("filename"), "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    for part in (1, 0):
        files.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        arrived = read_file_stream(t.spark, f"{base}/in", "*.parquet", files.schema)
        ingest_stream(arrived, base, size=WHOLE, overlap=0, headers=False)
    questions = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    found = []
    for held in ("all", "kept"):
        if held == "kept":
            remove_documents(files.filter("doc_id % 11 = 0").select("doc_id"), base)
        hits = staged(search_stored(t.spark, base, questions, 20))
        found.append(hits.select(F.lit(held).alias("held"), "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"))
    return found[0].unionByName(found[1])
