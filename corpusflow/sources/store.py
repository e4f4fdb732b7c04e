"""Chunk store and registry tables: upsert, delete, fingerprint, caches.

A store is a folder of numbered layers: complete snapshots (``b<n>``) and the
batches written since (``d<n>``). A layer counts once its ``_SUCCESS`` file is
there, so readers never see half a write and a lost writer leaves the old state
in place. A batch may replace whole documents (``x<n>`` names them): what was
written of them before is gone. Where it holds nothing of other documents, it
is ``w<n>`` that names them, and no row of it meets an older one. Reading lays the batches over the snapshot,
last write first;
``compact`` folds them into a new snapshot when that is wanted. Numbers are
claimed by creating a marker file, so two writers never share one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.scalars import (
    ATTACHMENT_EXTENSIONS,
    CANONICAL_MIME,
    REF_PATTERN,
    lookup,
)

READY, FAILED, PROCESSING = "READY", "FAILED", "PROCESSING"


# Layers ------------------------------------------------------------------------

# Bytes of named documents that reading broadcasts; more of them are joined by shuffle.
NAMED_BYTES = 32 << 20


def _layers(spark: SparkSession, folder: str) -> tuple[int | None, list[int]]:
    """Number of the newest complete snapshot and of the batches after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None, []
    found: dict[str, list[int]] = {"b": [], "d": []}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name[:1] in found and name[1:].isdigit() and fs.exists(done):
            found[name[0]].append(int(name[1:]))
    base = max(found["b"], default=None)
    return base, sorted(n for n in found["d"] if base is None or n > base)


def _claim(spark: SparkSession, folder: str) -> int:
    """A layer number that no other writer has."""
    base, batches = _layers(spark, folder)
    number = max([base or 0, *batches]) + 1
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    while not fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_claims/{number}")):
        number += 1
    return number


def _named(spark: SparkSession, folder: str, batches: list[int]) -> dict[int, str]:
    """The folders that name the documents replaced by each batch that replaced some."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return {n: f"{folder}/{kind}{n}" for n in batches for kind in "xw" if fs.exists(path(f"{folder}/{kind}{n}/_SUCCESS"))}


def _replaced(spark: SparkSession, named: dict[int, str]) -> DataFrame:
    """``doc_id, _gone``: the last batch that replaced each document."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    sizes = [path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path(f)).getLength() for f in named.values()]
    parts = [spark.read.parquet(f).select("doc_id", F.lit(n).alias("_gone")) for n, f in named.items()]
    gone = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.max("_gone").alias("_gone"))
    return F.broadcast(gone) if sum(sizes) <= NAMED_BYTES else gone


def read_store(spark: SparkSession, folder: str, key: str | list[str] = "chunk_id") -> DataFrame | None:
    """The current rows, or None for an empty store."""
    base, batches = _layers(spark, folder)
    snapshot = None if base is None else spark.read.parquet(f"{folder}/b{base}")
    if not batches:
        return snapshot

    def union(numbers: list[int]) -> DataFrame:
        parts = [spark.read.parquet(f"{folder}/d{n}").withColumn("_layer", F.lit(n)) for n in numbers]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    named = _named(spark, folder, batches)
    # Names matter to older rows only: none are older than the first batch of a store without a snapshot,
    # and the rows of the last batch that names documents are not older than any.
    later = {n: f for n, f in named.items() if base is not None or n > batches[0]}
    gone = _replaced(spark, later) if later else None
    old = [n for n in batches if n < max(later, default=0)]
    new = [n for n in batches if n not in old]
    written = union(new)
    if old:
        alive = union(old).join(gone, "doc_id", "left").filter("_gone IS NULL OR _layer >= _gone").drop("_gone")
        written = alive.unionByName(written, allowMissingColumns=True)
    if gone is not None and snapshot is not None:
        snapshot = snapshot.join(gone, "doc_id", "left_anti")
    if all(n in named and named[n].endswith(f"/w{n}") for n in batches):
        written = written.drop("_layer")
        return written if snapshot is None else snapshot.unionByName(written, allowMissingColumns=True)
    if snapshot is None:
        return last_written(written, key, "_layer")
    return upsert(snapshot, written, key, "_layer")


def publish(df: DataFrame, folder: str) -> int:
    """Write ``df`` as a complete snapshot and return its number."""
    number = _claim(df.sparkSession, folder)
    df.write.mode("overwrite").parquet(f"{folder}/b{number}")
    return number


def append(batch: DataFrame, folder: str, replaced: DataFrame | None = None, whole: bool = False) -> int:
    """Write a batch of upserts; its cost does not grow with the store.

    Everything stored of the documents in ``replaced`` (``doc_id``) goes; an
    empty batch that replaces documents deletes them. ``whole`` says that every
    row of the batch is of one of these documents and that no key comes twice
    in it, so that a reader need not look for older rows of the same key.
    """
    number = _claim(batch.sparkSession, folder)
    if replaced is not None:
        replaced.select("doc_id").distinct().write.mode("overwrite").parquet(f"{folder}/{'w' if whole else 'x'}{number}")
    batch.write.mode("overwrite").parquet(f"{folder}/d{number}")
    return number


def compact(spark: SparkSession, folder: str, key: str | list[str] = "chunk_id") -> int | None:
    """Fold the batches into a new snapshot: a maintenance job, never part of a write."""
    current = read_store(spark, folder, key)
    return None if current is None else publish(current, folder)


# Rows ----------------------------------------------------------------------------


def last_written(batch: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row per key: the last write of the batch."""
    keys = [key] if isinstance(key, str) else key
    columns = [c for c in batch.columns if c not in (*keys, order)]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, batch: DataFrame, key: str | list[str] = "chunk_id", order: str = "seq") -> DataFrame:
    """``old`` with the batch written over it."""
    new = last_written(batch, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(remaining chunks, count of deleted chunks per document)``."""
    remaining = chunks.join(doomed, "document_id", "left_anti")
    removed = (
        chunks.join(doomed, "document_id", "left_semi")
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("chunks_deleted"))
    )
    return remaining, removed


def chunks_of(chunks: DataFrame, document_id) -> DataFrame:
    wanted = chunks.filter(F.col("document_id") == document_id)
    return wanted.orderBy("page_number", "chunk_index")


def fingerprint(chunks: DataFrame, *columns: str) -> DataFrame:
    """Count and content token; same content gives the same token in any order.

    The token is a sum over rows, so equal rows do not cancel each other out.
    """
    parts = [F.concat(F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")) for c in columns]
    digest = F.md5(F.concat_ws(",", *(F.coalesce(p, F.lit("null")) for p in parts)))
    number = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("decimal(38,0)")
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("token"))


def pivot_metadata(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``chunk_id, key, value`` rows -> one row per chunk."""
    return entries.groupBy("chunk_id").pivot("key", keys).agg(F.first("value"))


def with_columns_added(old: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add missing columns with their default; columns already there stay."""
    missing = {name: value for name, value in defaults.items() if name not in old.columns}
    return old.withColumns(missing) if missing else old


# Vector cache ----------------------------------------------------------------------


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts without a cached vector, each once: ``key, text``."""
    keyed = texts.select(cache_key(model, F.col("text")).alias("key"), "text")
    return keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def embed_with_cache(
    texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The cache with the missing vectors added: ``key, vector``."""
    fresh = embed(cache_misses(texts, cache, model)).select("key", F.col("embedding").alias("vector"))
    return cache.select("key", "vector").unionByName(fresh)


# Registry ---------------------------------------------------------------------------


def latest_status(events: DataFrame) -> DataFrame:
    """Current registry rows from an append-only table of status events.

    ``events``: ``document_id, seq, status, chunk_count, reason, created_at``.
    A later READY clears the reason, a FAILED one has zero chunks.
    """
    state = events.groupBy("document_id").agg(
        F.max_by(F.struct("status", "chunk_count", "reason"), "seq").alias("s"),
        F.min("created_at").alias("created_at"),
    )
    status = F.col("s.status")
    return state.select(
        "document_id",
        status.alias("status"),
        F.when(status == READY, F.col("s.chunk_count")).otherwise(0).alias("chunk_count"),
        F.when(status == FAILED, F.col("s.reason")).alias("failure_reason"),
        "created_at",
    )


def newest_first(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.col("created_at").desc(), "document_id")


def ready_lines(registry: DataFrame) -> DataFrame:
    """One line per searchable document."""
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("- "), F.col("filename")),
        F.concat(F.lit("title: "), F.coalesce("title", F.lit("unknown"))),
        F.concat(
            F.col("page_count").cast("string"), F.lit(" pages, "),
            F.col("chunk_count").cast("string"), F.lit(" searchable passages"),
        ),
    )
    return registry.filter(F.col("status") == READY).select("document_id", line.alias("line"))


def ready_without_chunks(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """READY documents the store knows nothing of: to be ingested again."""
    ready = registry.filter(F.col("status") == READY).select("document_id")
    return ready.join(chunks.select("document_id"), "document_id", "left_anti")


def orphan_chunks(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(registry.select("document_id"), "document_id", "left_anti")


def content_duplicates(documents: DataFrame) -> DataFrame:
    """Add ``canonical_id``: the oldest READY document with the same content.

    ``documents``: ``document_id, content_hash, status, created_at``. The
    canonical ids are aggregated map-side; a hash shared by a third of all rows
    is left to skew-join splitting on the way back.
    """
    canonical = (
        documents.filter(F.col("status") == READY)
        .groupBy("content_hash")
        .agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("canonical_id"))
    )
    return documents.join(canonical, "content_hash", "left")


# Attachments ---------------------------------------------------------------------------


def attachment_refs(uploads: DataFrame) -> DataFrame:
    """``content, mime`` -> content-addressed ``ref`` and canonical mime, or a reason."""
    suffix = lookup(ATTACHMENT_EXTENSIONS, F.lower(F.trim(F.col("mime"))))
    reason = F.when(F.octet_length("content") == 0, "data must not be empty.").when(
        suffix.isNull(), F.concat(F.lit("Cannot store an attachment of type '"), F.col("mime"), F.lit("'."))
    )
    ref = F.concat(F.sha2("content", 256), suffix)
    return uploads.withColumns(
        {
            "reject_reason": reason,
            "ref": F.when(reason.isNull(), ref),
            "canonical_mime": F.when(reason.isNull(), lookup(CANONICAL_MIME, suffix)),
        }
    )


def stored_once(attachments: DataFrame) -> DataFrame:
    return attachments.filter(F.col("ref").rlike(REF_PATTERN)).dropDuplicates(["ref"])


def unreferenced(media: DataFrame, messages: DataFrame) -> DataFrame:
    """Media keys no message points at. ``messages.refs`` is an array."""
    used = messages.select(F.explode("refs").alias("ref"))
    return media.join(used, "ref", "left_anti")
