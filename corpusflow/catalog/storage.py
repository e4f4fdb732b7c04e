"""Chunk store, registry, cache and attachment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog.registry import Tables, query
from corpusflow.functions import models
from corpusflow.functions.scalars import ATTACHMENT_EXTENSIONS, CANONICAL_MIME, iso_date
from corpusflow.sources import store as st


@query(
    "chunk_upsert",
    """WITH old AS (SELECT doc_id AS chunk_id, text, source FROM documents WHERE doc_id % 15 <> 0),
new AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN 'v3 ' ELSE 'v2 ' END || text AS text, source FROM documents WHERE doc_id % 5 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)""",
)
def chunk_upsert(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source")

    def write(seq: int, every: int) -> DataFrame:
        return chunks.filter(F.col("chunk_id") % every == 0).select(
            "chunk_id", F.concat(F.lit(f"v{seq + 1} "), "text").alias("text"), "source", F.lit(seq).alias("seq")
        )

    return st.upsert(chunks.filter("chunk_id % 15 <> 0"), write(1, 5).unionByName(write(2, 10)))


def owned(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    return t.documents.select(
        doc.alias("chunk_id"), (doc % 50).alias("document_id"), (doc % 7 + 1).alias("page_number"),
        F.floor(doc / 7).alias("chunk_index"), "text",
    )


@query(
    "chunk_delete_by_document",
    "SELECT doc_id % 50 AS document_id, count(*) AS chunks_deleted FROM documents WHERE doc_id % 50 IN (3, 17, 40) GROUP BY 1",
)
def chunk_delete_by_document(t: Tables) -> DataFrame:
    chunks = owned(t)
    doomed = chunks.select("document_id").filter("document_id IN (3, 17, 40)").distinct()
    return st.delete_documents(chunks, doomed)[1]


@query(
    "chunks_after_delete",
    "SELECT doc_id AS chunk_id, doc_id % 50 AS document_id FROM documents WHERE doc_id % 50 NOT IN (3, 17, 40)",
)
def chunks_after_delete(t: Tables) -> DataFrame:
    chunks = owned(t)
    doomed = chunks.select("document_id").filter("document_id IN (3, 17, 40)").distinct()
    return st.delete_documents(chunks, doomed)[0].select("chunk_id", "document_id")


@query(
    "chunks_of_document",
    "SELECT doc_id AS chunk_id, doc_id % 7 + 1 AS page_number, doc_id // 7 AS chunk_index, text FROM documents WHERE doc_id % 50 = 17",
)
def chunks_of_document(t: Tables) -> DataFrame:
    return st.chunks_of(owned(t), 17).drop("document_id")


@query(
    "store_count_fingerprint",
    """SELECT count(*) AS n_chunks, sum(('0x' || left(md5(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id || ',' ||
      octet_length(encode(text)) || ':' || text), 15))::BIGINT)::HUGEINT::VARCHAR AS token FROM documents""",
)
def store_count_fingerprint(t: Tables) -> DataFrame:
    return st.fingerprint(owned(t), "chunk_id", "text")


MODEL = "hash-256"


def cached(t: Tables) -> DataFrame:
    known = t.documents.filter("doc_id % 2 = 0").select("text")
    return known.select(st.cache_key(MODEL, F.col("text")).alias("key")).distinct()


KEYS = f"""keyed AS (SELECT doc_id, sha256('{MODEL}' || chr(0) || text) AS key, text FROM documents),
cache AS (SELECT DISTINCT key FROM keyed WHERE doc_id % 2 = 0)"""


@query(
    "embedding_cache_read_write",
    f"WITH {KEYS} SELECT key, key IN (SELECT key FROM cache) AS was_cached FROM keyed GROUP BY 1",
)
def embedding_cache_read_write(t: Tables) -> DataFrame:
    cache = models.hashed_embedding(
        t.documents.filter("doc_id % 2 = 0").select(st.cache_key(MODEL, F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    ).select("key", F.col("embedding").alias("vector"))
    filled = st.embed_with_cache(t.documents.select("text"), cache, MODEL, models.hashed_embedding)
    before = cache.select("key", F.lit(True).alias("was_cached"))
    return filled.select("key").join(before, "key", "left").select(
        "key", F.coalesce("was_cached", F.lit(False)).alias("was_cached")
    )


@query("cache_misses", f"WITH {KEYS} SELECT DISTINCT key, text FROM keyed WHERE key NOT IN (SELECT key FROM cache)")
def cache_misses(t: Tables) -> DataFrame:
    return st.cache_misses(t.documents.select("text"), cached(t), MODEL)


def status_events(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    made = (doc * 37 % 1000).alias("created_at")

    def event(seq: int, where: str, status: str, count, reason) -> DataFrame:
        return t.documents.filter(where).select(
            doc.alias("document_id"), F.lit(seq).alias("seq"), F.lit(status).alias("status"),
            count.alias("chunk_count"), F.lit(reason).cast("string").alias("reason"), made,
        )

    none, many = F.lit(0).cast("bigint"), doc % 9 + 1
    return (
        event(1, "true", st.PROCESSING, none, None)
        .unionByName(event(2, "doc_id % 4 = 1", st.FAILED, none, "no text"))
        .unionByName(event(2, "doc_id % 4 IN (0, 2)", st.READY, many, None))
        .unionByName(event(3, "doc_id % 8 = 1", st.READY, many, None))
    )


REGISTRY = """
registry AS (
  SELECT doc_id AS document_id, CASE WHEN doc_id % 8 = 1 OR doc_id % 4 IN (0, 2) THEN 'READY' WHEN doc_id % 4 = 1 THEN 'FAILED' ELSE 'PROCESSING' END AS status,
    doc_id * 37 % 1000 AS created_at FROM documents),
full_registry AS (
  SELECT document_id, status, CASE WHEN status = 'READY' THEN document_id % 9 + 1 ELSE 0 END AS chunk_count,
    CASE WHEN status = 'FAILED' THEN 'no text' END AS failure_reason, created_at FROM registry)"""


@query("document_registry", f"WITH {REGISTRY} SELECT * FROM full_registry")
def document_registry(t: Tables) -> DataFrame:
    return st.latest_status(status_events(t))


@query("registry_newest_first", f"WITH {REGISTRY} SELECT document_id, created_at FROM registry ORDER BY created_at DESC, document_id")
def registry_newest_first(t: Tables) -> DataFrame:
    return st.newest_first(st.latest_status(status_events(t))).select("document_id", "created_at")


@query(
    "ready_documents",
    f"WITH {REGISTRY} SELECT r.document_id, '- ' || source || '.txt | title: ' || CASE WHEN r.document_id % 5 = 0 THEN 'unknown' ELSE lang END "
    "|| ' | 1 pages, ' || chunk_count || ' searchable passages' AS line FROM full_registry r JOIN documents d ON d.doc_id = r.document_id WHERE status = 'READY'",
)
def ready_documents(t: Tables) -> DataFrame:
    named = t.documents.select(
        F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".txt")).alias("filename"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("title"), F.lit(1).alias("page_count"),
    )
    return st.ready_lines(st.latest_status(status_events(t)).join(named, "document_id"))


@query(
    "ready_without_chunks",
    f"WITH {REGISTRY} SELECT document_id FROM registry WHERE status = 'READY' AND document_id NOT IN (SELECT vec_id FROM embeddings)",
)
def ready_without_chunks(t: Tables) -> DataFrame:
    chunks = t.embeddings.select(F.col("vec_id").alias("document_id"))
    return st.ready_without_chunks(st.latest_status(status_events(t)), chunks)


@query(
    "orphan_chunks",
    "SELECT vec_id AS document_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)",
)
def orphan_chunks(t: Tables) -> DataFrame:
    registry = t.documents.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"))
    return st.orphan_chunks(registry, t.embeddings.select(F.col("vec_id").alias("document_id"), "label"))


@query(
    "content_dedup",
    """WITH d AS (SELECT doc_id AS document_id, sha256(text) AS h, CASE WHEN doc_id % 4 = 1 THEN 'FAILED' ELSE 'READY' END AS status FROM documents),
c AS (SELECT h, min(document_id) AS canonical_id FROM d WHERE status = 'READY' GROUP BY 1)
SELECT document_id, canonical_id, coalesce(canonical_id <> document_id, false) AS is_duplicate FROM d LEFT JOIN c USING (h)""",
)
def content_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select(
        F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("doc_id") % 4 == 1, st.FAILED).otherwise(st.READY).alias("status"), F.col("doc_id").alias("created_at"),
    )
    return st.content_duplicates(rows).select(
        "document_id", "canonical_id",
        F.coalesce(F.col("canonical_id") != F.col("document_id"), F.lit(False)).alias("is_duplicate"),
    )


MIMES = (*ATTACHMENT_EXTENSIONS, "text/plain", " IMAGE/PNG ")
MIME_CASE = "CASE page_id % {n} {whens} END".format(
    n=len(MIMES), whens=" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MIMES))
)
EXT_CASE = "CASE lower(trim(mime)) {} END".format(" ".join(f"WHEN '{m}' THEN '{e}'" for m, e in ATTACHMENT_EXTENSIONS.items()))
CANON_CASE = "CASE ext {} END".format(" ".join(f"WHEN '{e}' THEN '{m}'" for e, m in CANONICAL_MIME.items()))


@query(
    "attachment_content_address",
    f"""WITH up AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN '' ELSE 'same' || page_id % 20 END AS content, {MIME_CASE} AS mime FROM pages),
e AS (SELECT *, {EXT_CASE} AS ext FROM up),
r AS (SELECT *, sha256(content) || ext AS ref, {CANON_CASE} AS canonical_mime FROM e WHERE content <> '' AND ext IS NOT NULL)
SELECT ref, any_value(canonical_mime) AS canonical_mime FROM r GROUP BY 1""",
)
def attachment_content_address(t: Tables) -> DataFrame:
    number = F.col("page_id")
    mime = F.element_at(F.array(*[F.lit(m) for m in MIMES]), (number % len(MIMES) + 1).cast("int"))
    content = F.when(number % 13 == 0, "").otherwise(F.concat(F.lit("same"), (number % 20).cast("string")))
    uploads = t.pages.select(F.encode(content, "UTF-8").alias("content"), mime.alias("mime"))
    return st.stored_once(st.attachment_refs(uploads)).select("ref", "canonical_mime")


@query(
    "unreferenced_media",
    "SELECT 'media-' || page_id AS ref FROM pages WHERE page_id NOT IN (SELECT conv_id * 3 + turn FROM conversations)",
)
def unreferenced_media(t: Tables) -> DataFrame:
    media = t.pages.select(F.concat(F.lit("media-"), F.col("page_id").cast("string")).alias("ref"))
    refs = F.array(F.concat(F.lit("media-"), (F.col("conv_id") * 3 + F.col("turn")).cast("string")))
    return st.unreferenced(media, t.conversations.select(refs.alias("refs")))


@query(
    "store_inspect_pivot",
    "SELECT doc_id AS chunk_id, source AS filename, (doc_id % 7 + 1)::VARCHAR AS page_number, left(text, 72) AS text FROM documents",
)
def store_inspect_pivot(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    pairs = F.explode(
        F.create_map(
            F.lit("filename"), F.col("source"), F.lit("page_number"), (doc % 7 + 1).cast("string"), F.lit("text"), F.left("text", F.lit(72))
        )
    )
    entries = t.documents.select(doc.alias("chunk_id"), pairs)
    return st.pivot_metadata(entries, ["filename", "page_number", "text"])


@query(
    "schema_add_columns",
    "SELECT conv_id, turn, 'text' AS modality, NULL::VARCHAR AS attachment_ref FROM conversations WHERE conv_id % 2 = 0 "
    "UNION ALL SELECT conv_id, turn, 'image', 'r' || turn FROM conversations WHERE conv_id % 2 = 1",
)
def schema_add_columns(t: Tables) -> DataFrame:
    defaults = {"modality": F.lit("text"), "attachment_ref": F.lit(None).cast("string")}
    old = t.conversations.filter("conv_id % 2 = 0").select("conv_id", "turn")
    new = t.conversations.filter("conv_id % 2 = 1").select(
        "conv_id", "turn", F.lit("image").alias("modality"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("attachment_ref")
    )
    upgraded = st.with_columns_added(st.with_columns_added(old, defaults), defaults)
    return upgraded.unionByName(st.with_columns_added(new, defaults))


@query(
    "iso_date_normalise",
    """WITH o AS (SELECT o_orderkey, (DATE '1994-01-01' + (o_orderkey % 900)::INT) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS document_date FROM o""",
)
def iso_date_normalise(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.date_add(F.lit("1994-01-01").cast("date"), (key % 900).cast("int"))
    written = (
        F.when(key % 7 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 7 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 7 == 2, F.date_format(day, "d MMMM yyyy"))
        .when(key % 7 == 3, F.date_format(day, "MMMM d, yyyy"))
        .when(key % 7 == 4, F.date_format(day, "yyyy/MM/dd"))
        .when(key % 7 == 5, F.date_format(day, "yyyy"))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-05:00")))
    )
    return t.orders.select("o_orderkey", iso_date(written).alias("document_date"))


