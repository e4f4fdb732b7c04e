"""Files in, chunks and registry rows out; a bad file is a row, not a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.models import CHARACTERS, Measure
from corpusflow.functions.scalars import extension
from corpusflow.operators import blocks as bl
from corpusflow.operators import chunking as ch
from corpusflow.operators.keyword import chunk_lengths, chunk_terms, corpus_stats, query_terms, require_positive, stored_topk
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import staged
from corpusflow.sources import files as fi
from corpusflow.sources import store as st

NO_TEXT = "No text could be extracted: the pages appear to contain no words."
NO_READER = "No reader for this file type: supply the text of its pages."
HTML = (".html", ".htm")
# Admitted formats whose bytes are no text; reading them takes a codec outside this library.
CODED = (".pdf", ".docx")
DELIMITED = (".csv", ".tsv")
# Ids of originals that are broadcast; more of them are joined by shuffle.
BROADCAST_IDS = 4_000_000


def parsed_blocks(files: DataFrame) -> DataFrame:
    """``doc_id, filename, text`` -> blocks, by the loader of the extension."""
    suffix = extension(F.col("filename"))
    marked = files.withColumn("suffix", suffix)
    pages = marked.filter(F.col("suffix").isin(*HTML)).select("doc_id", F.col("text").alias("html"))
    tables = marked.filter(F.col("suffix").isin(*DELIMITED)).select("doc_id", "text")
    plain = marked.filter(~F.col("suffix").isin(*HTML, *DELIMITED, *CODED))
    _, body = bl.front_matter(F.col("text"))
    lines = plain.select("doc_id", body.alias("text"))
    return (
        bl.html_blocks(pages)
        .unionByName(bl.line_blocks(lines))
        .unionByName(fi.delimited_blocks(tables))
    )


def marked_plain(files: DataFrame, slim: DataFrame) -> DataFrame:
    """``doc_id, filename, text, plain``: where ``plain``, the text is the paragraphs of ``blocks.plain_text``.

    Staged, since what follows reads either kind alone. A document that comes
    twice in the batch (``slim``) is left to ``parsed_blocks``.
    """
    twice = broadcast_if_small(slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("twice")))
    lines = ~extension(F.col("filename")).isin(*HTML, *DELIMITED, *CODED)
    read = files.join(twice, "doc_id", "left").withColumn("body", F.when(lines & F.col("twice").isNull(), bl.plain_text(F.col("text"))))
    plain = F.col("body").isNotNull()
    return staged(read.select("doc_id", "filename", F.when(plain, F.col("body")).otherwise(F.col("text")).alias("text"), plain.alias("plain")))


def ingest(
    files: DataFrame,
    strategy: str = "recursive",
    size: int = 1000,
    overlap: int = 200,
    measure: Measure = CHARACTERS,
    headers: bool = True,
    known: DataFrame | None = None,
    **strategy_inputs,
) -> tuple[DataFrame, DataFrame]:
    """``(chunks, registry)`` of a batch of files.

    ``files``: ``doc_id, filename, text, n_bytes``. The same content is
    ingested once, under its smallest id; ``known`` (``doc_id, content_hash``)
    are documents that are stored already. Chunks are staged, because they are
    stored and counted.
    """
    admitted = fi.admit(files)
    # Texts are hashed once; what follows reads the hashes, and originals are found in place by their ids.
    slim = staged(admitted.select("doc_id", "filename", F.sha2("text", 256).alias("content_hash"), "reject_reason"))
    owners = slim.filter("reject_reason IS NULL").select("doc_id", "content_hash")
    owners = owners if known is None else owners.unionByName(known.select("doc_id", "content_hash"))
    first = staged(owners.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_id")))
    ids = broadcast_if_small(first.select("canonical_id"), BROADCAST_IDS)
    originals = admitted.filter("reject_reason IS NULL").join(ids, F.col("doc_id") == F.col("canonical_id"), "left_semi")
    texts = marked_plain(originals, slim)
    sections = bl.section_paths(bl.detect_headings(parsed_blocks(texts.filter("NOT plain"))))
    runs = ch.text_runs(sections, size, measure, headers)
    plain = ch.plain_runs(texts.filter("plain"), size, measure)
    chunks = staged(ch.chunk_all(strategy, runs, plain, overlap, measure=measure, **strategy_inputs))
    counts = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("page_no").alias("page_count")
    )
    joined = slim.join(first, "content_hash", "left").join(counts, "doc_id", "left")
    rejected = F.col("reject_reason").isNotNull()
    duplicate = ~rejected & (F.col("canonical_id") != F.col("doc_id"))
    has_chunks = F.coalesce("chunk_count", F.lit(0)) > 0
    status = F.when(rejected, "REJECTED").when(duplicate, "DUPLICATE").when(has_chunks, st.READY).otherwise(st.FAILED)
    registry = joined.select(
        "doc_id",
        "filename",
        status.alias("status"),
        F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"),
        F.coalesce("page_count", F.lit(0)).cast("bigint").alias("page_count"),
        F.when(rejected, F.col("reject_reason"))
        .when(~duplicate & ~has_chunks, F.when(extension(F.col("filename")).isin(*CODED), NO_READER).otherwise(NO_TEXT))
        .alias("failure_reason"),
        F.when(duplicate, F.col("canonical_id")).alias("duplicate_of"),
        "content_hash",
    )
    return chunks, registry


def store_batch(files: DataFrame, folder: str, **options) -> DataFrame:
    """Ingest a batch into the store below ``folder`` and return its registry rows.

    The registry, chunks and postings then equal those of one ingest over all
    files so far, whatever the order of batches: a document that comes again is
    replaced, content that is stored already is a duplicate, a smaller id takes
    its content over, and a duplicate whose original changed takes the chunks
    that were stored for it. Only documents of the batch, and stored ones of
    the same content, are touched. Handling a batch twice changes nothing.
    """
    spark = files.sparkSession
    stored = st.read_store(spark, f"{folder}/registry", "doc_id")
    if stored is None:
        chunks, registry = ingest(files, **options)
        _write(folder, registry, chunks, registry.select("doc_id"))
        return registry
    ids = files.select("doc_id").distinct()
    hashes = files.select(F.sha2("text", 256).alias("content_hash"))
    others = _same_content(stored, ids, hashes)
    chunks, registry = ingest(files, known=others, **options)
    registry = staged(registry)
    changed, heirs = _new_owners(stored, others, registry.filter("status <> 'REJECTED'"))
    changed = staged(registry.unionByName(changed))
    added = chunks.unionByName(staged(_inherited(st.read_store(spark, f"{folder}/chunks"), heirs)))
    _write(folder, changed, added, changed.select("doc_id"))
    return registry


def remove_documents(doomed: DataFrame, folder: str) -> DataFrame:
    """Delete documents (``doc_id``) from registry, chunks and postings; return ``doc_id, chunks_deleted``.

    The store then equals one that never got them: the smallest duplicate of a
    deleted original takes its stored chunks over. Unknown ids are ignored,
    repeated and null ones too; deleting twice changes nothing.
    """
    spark = doomed.sparkSession
    stored = st.read_store(spark, f"{folder}/registry", "doc_id")
    if stored is None:
        return spark.createDataFrame([], "doc_id bigint, chunks_deleted bigint")
    gone = staged(stored.join(doomed.select("doc_id").distinct(), "doc_id", "left_semi").select(*stored.columns))
    others = _same_content(stored, gone.select("doc_id"), None)
    changed, heirs = _new_owners(stored, others, None)
    changed = staged(changed)
    added = staged(_inherited(st.read_store(spark, f"{folder}/chunks"), heirs))
    _write(folder, changed, added, changed.select("doc_id").unionByName(gone.select("doc_id")))
    return gone.select("doc_id", F.col("chunk_count").alias("chunks_deleted"))


def _same_content(stored: DataFrame, ids: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """Registry rows of other documents whose content is among ``hashes`` or was that of one of ``ids``."""
    touched = stored.join(ids, "doc_id", "left_semi").select("content_hash")
    touched = (touched if hashes is None else touched.unionByName(hashes)).distinct()
    others = stored.filter("status <> 'REJECTED'").join(ids, "doc_id", "left_anti")
    return staged(others.join(touched, "content_hash", "left_semi").select(*stored.columns))


def _new_owners(stored: DataFrame, others: DataFrame, arrived: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Registry rows of ``others`` whose owner changes, and those of them that own their content from now on."""
    claims = others.select("doc_id", "content_hash")
    claims = claims if arrived is None else claims.unionByName(arrived.select("doc_id", "content_hash"))
    first = claims.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_id"))
    owner = F.when(F.col("canonical_id") != F.col("doc_id"), F.col("canonical_id"))
    moved = staged(others.join(first, "content_hash").filter(~F.col("duplicate_of").eqNullSafe(owner)))
    demoted = moved.filter("canonical_id <> doc_id").select(
        "doc_id", "filename", F.lit("DUPLICATE").alias("status"), F.lit(0).cast("bigint").alias("chunk_count"),
        F.lit(0).cast("bigint").alias("page_count"), F.lit(None).cast("string").alias("failure_reason"),
        F.col("canonical_id").alias("duplicate_of"), "content_hash",
    )
    heirs = moved.filter("canonical_id = doc_id").select("doc_id", "filename", "duplicate_of", "content_hash")
    old = stored.select(F.col("doc_id").alias("duplicate_of"), "status", "chunk_count", "page_count", "failure_reason")
    promoted = heirs.join(old, "duplicate_of").select(
        "doc_id", "filename", "status", "chunk_count", "page_count", "failure_reason",
        F.lit(None).cast(stored.schema["duplicate_of"].dataType).alias("duplicate_of"), "content_hash",
    )
    return demoted.unionByName(promoted), heirs


def _write(folder: str, registry: DataFrame, chunks: DataFrame, replaced: DataFrame) -> None:
    """One batch to the postings, the chunk lengths, the chunks and, last, the registry."""
    # Counted where the chunk lies, so no term is one file; runs in order of
    # terms let a search skip the pages of other terms.
    st.append(chunk_terms(chunks), f"{folder}/postings", replaced, whole=True)
    st.append(chunk_lengths(chunks), f"{folder}/lengths", replaced, whole=True)
    st.append(chunks, f"{folder}/chunks", replaced, whole=True)
    st.append(registry, f"{folder}/registry", replaced)


def search_stored(spark: SparkSession, folder: str, queries: DataFrame, k: int = 5, few_terms: int = 1000) -> DataFrame:
    """BM25 over what ``store_batch`` wrote: ``query_id, chunk_id, score, rank``; no text is read.

    Of the postings only the row groups that can hold a term of the questions
    are read while the terms are few; for more, postings are joined with them.
    The result does not depend on it. An empty store gives no row.
    """
    require_positive(top_k=k)
    postings = st.read_store(spark, f"{folder}/postings", ["chunk_id", "term"])
    if postings is None:
        return spark.createDataFrame([], "query_id bigint, chunk_id string, score double, rank int")
    terms = staged(query_terms(queries))
    some = [r["term"] for r in terms.select("term").distinct().limit(few_terms + 1).collect()]
    if len(some) <= few_terms:
        postings = postings.filter(F.col("term").isin(some))
    stats = corpus_stats(st.read_store(spark, f"{folder}/lengths"))
    return stored_topk(postings, stats, terms, k)


def _inherited(chunks: DataFrame, heirs: DataFrame) -> DataFrame:
    """The stored chunks of an original, under the id of the document that takes its place."""
    pairs = heirs.select(F.col("doc_id").alias("_new"), F.col("duplicate_of").alias("doc_id"))

    def renamed(name: str):
        own = F.concat(F.col("_new").cast("string"), F.expr(f"substring({name}, instr({name}, '::'))"))
        return F.when(F.col(name) != "", own).otherwise(F.col(name)).alias(name)

    columns = [F.col("_new").alias(c) if c == "doc_id" else renamed(c) if c in ("chunk_id", "parent_id") else F.col(c) for c in chunks.columns]
    return chunks.join(pairs, "doc_id").select(*columns)
