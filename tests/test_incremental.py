"""Documents that come again; other orders of batches are checked by the query against its SQL."""

from corpusflow.operators.keyword import bm25_topk, term_frequency
from corpusflow.plans.ingest import ingest, remove_documents, search_stored, store_batch
from corpusflow.sources import store as st

SCHEMA = "doc_id bigint, filename string, text string, n_bytes bigint"


def files(spark, *rows):
    return spark.createDataFrame([(i, f"f{i}{ext}", text, len(text)) for i, ext, text in rows], SCHEMA)


LONG = "A sentence about refunds. " * 12

def state(spark, folder):
    chunks = st.read_store(spark, f"{folder}/chunks")
    postings = st.read_store(spark, f"{folder}/postings", ["chunk_id", "term"])
    registry = st.read_store(spark, f"{folder}/registry", "doc_id")
    return compare(chunks, postings, registry)


def compare(chunks, postings, registry):
    return (
        sorted((r.chunk_id, r.doc_id, r.text, r.parent_id) for r in chunks.collect()),
        sorted((r.chunk_id, r.term, r.tf) for r in postings.collect()),
        sorted(str((r.doc_id, r.status, r.duplicate_of, r.chunk_count, r.failure_reason)) for r in registry.collect()),
    )


def whole(spark, rows):
    chunks, registry = ingest(files(spark, *rows), size=80, overlap=10)
    return compare(chunks, term_frequency(chunks), registry)


def test_documents_that_come_again_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "s")
    store_batch(files(spark, (1, ".txt", LONG), (2, ".txt", LONG), (3, ".txt", LONG)), folder, size=80, overlap=10)
    # The original becomes shorter; its first duplicate takes the stored chunks over.
    for _ in range(2):  # a batch that is handled twice changes nothing
        store_batch(files(spark, (1, ".txt", "Short now.")), folder, size=80, overlap=10)
    assert state(spark, folder) == whole(spark, [(1, ".txt", "Short now."), (2, ".txt", LONG), (3, ".txt", LONG)])


def hits(found):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in found.collect())


def test_deleted_documents_leave_registry_chunks_postings_and_search(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = [(1, ".txt", LONG), (2, ".txt", LONG), (3, ".txt", LONG), (4, ".txt", "A cat sat. " * 20), (5, ".exe", "x"), (6, ".txt", " ")]
    store_batch(files(spark, *rows[:3]), folder, size=80, overlap=10)
    store_batch(files(spark, *rows[3:]), folder, size=80, overlap=10)
    questions = spark.createDataFrame([(1, "refunds and a cat"), (2, "sentence"), (3, "nowhere"), (4, "")], "query_id bigint, text string")
    doomed = spark.createDataFrame([(1,), (4,), (4,), (5,), (99,), (None,)], "doc_id bigint")
    gone = {r.doc_id: r.chunks_deleted for r in remove_documents(doomed, folder).collect()}
    assert set(gone) == {1, 4, 5} and gone[5] == 0 < gone[4]
    assert remove_documents(doomed, folder).count() == 0
    chunks, registry = ingest(files(spark, rows[1], rows[2], rows[5]), size=80, overlap=10)
    assert state(spark, folder) == compare(chunks, term_frequency(chunks), registry)
    want = hits(bm25_topk(chunks, questions, 3))
    st.compact(spark, f"{folder}/postings", ["chunk_id", "term"])
    for few_terms in (1000, 1):
        assert want and hits(search_stored(spark, folder, questions, 3, few_terms)) == want


def test_search_of_an_empty_store(spark, tmp_path):
    questions = spark.createDataFrame([(1, "cat")], "query_id bigint, text string")
    assert search_stored(spark, str(tmp_path / "none"), questions).count() == 0
    assert remove_documents(questions.selectExpr("query_id AS doc_id"), str(tmp_path / "none")).count() == 0


def test_texts_are_hashed_once(spark, monkeypatch):
    from corpusflow.plans import ingest as module

    kept, real = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df: kept.append(df.columns) or real(df))
    files = spark.createDataFrame([(1, "a.txt", "x y", 3), (2, "b.txt", "x y", 3), (3, "c.exe", "z", 1)], "doc_id bigint, filename string, text string, n_bytes bigint")
    _, registry = module.ingest(files)
    assert {r["doc_id"]: r["status"] for r in registry.collect()} == {1: "READY", 2: "DUPLICATE", 3: "REJECTED"}
    # Before, every later step read and hashed all texts again.
    assert ["doc_id", "filename", "content_hash", "reject_reason"] in kept
