"""Texts without structure need no windows, postings and stored hits no shuffle per key or query."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import keyword as kw
from corpusflow.plans import ingest as plan
from corpusflow.sources import store as st

SCHEMA = "doc_id bigint, filename string, text string, n_bytes bigint"
PROSE = "Plain words of no shape. " * 9
TEXTS = [
    "", None, " \n ", PROSE, f"{PROSE}\n\n {PROSE}\n\n\n{PROSE}", "a\r\nb\r\n\r\nc d\re", "x \n\n\n y\t\n\tz", "one\n \ntwo",
    "   lead\n\n  tail  ", "a\n\n\x0b\n b", "x\x1cy\n\x1d\nz", " \nq　\n\n r", "tabs\tand  spaces \n here", "İ K Straße",
    "# Head\ntext below", "TITLE\n\nbody text.", "1. Intro\n\nbody of it", "SHOUT", "Chapter 4\nThe end", "2.1 Scope and a sentence.\n\nMore",
    "a\n---\nb", "text\n===\nmore", "=x\ny", "- item\n- item", "--\n", "---\ntitle: x\n---\nbody", " ---\nk: v\n...\nrest",
    "| a | b |\n|---|---|\n| 1 | 2 |", "|x|\n\nafter", "```\ncode\n\nmore\n```\ntail", "~~~", " ```\nodd", "p\u0085```x\ny", "\x01```\nfoo", "\x02t\x03u",
    "a\n" * 40, "w " * 90 + "\n" + "v " * 90,
]


def files(spark, texts):
    rows = [(i, f"f{i}.txt", t, None if t is None else len(t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("strategy", ["recursive", "parent_document"])
def test_plain_texts_give_the_chunks_that_their_blocks_give(spark, monkeypatch, strategy):
    given = files(spark, TEXTS)
    twice = given.unionByName(files(spark, ["First of two.\n\nMore.", "alone"]).filter("doc_id = 0").withColumn("doc_id", F.lit(3).cast("bigint")))
    chunks, registry = plan.ingest(twice, strategy=strategy, size=60, overlap=10)
    plain = twice.select("doc_id", plan.bl.plain_text(F.col("text")).alias("p")).filter("p <> ''")
    assert 15 < plain.count() < 30
    monkeypatch.setattr(plan.bl, "plain_text", lambda text: F.lit(None).cast("string"))
    want, want_registry = plan.ingest(twice, strategy=strategy, size=60, overlap=10)
    assert chunks.schema.simpleString() == want.schema.simpleString()
    # Two texts of one document mix line by line in either way, in an order that no rule fixes.
    assert rows(chunks.filter("doc_id <> 3")) == rows(want.filter("doc_id <> 3"))
    assert chunks.groupBy("chunk_id").count().filter("count > 1").count() == 0
    assert rows(registry.filter("doc_id <> 3")) == rows(want_registry.filter("doc_id <> 3"))


def test_normalize_gives_what_its_patterns_give(spark):
    texts = files(spark, [*(t for t in TEXTS if t is not None), " \n \n\n \n x  \t y\n\n\n\n z \r\n \r w "])
    out = F.col("text")
    for pattern, by in (("\r\n?", "\n"), (f"{tx.HORIZONTAL}+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    assert texts.filter(~tx.normalize(F.col("text")).eqNullSafe(tx.strip(out))).count() == 0


def test_postings_are_counted_in_the_row_and_in_order_of_terms(spark, monkeypatch):
    monkeypatch.setattr(kw, "POSTING_RUN", 7)
    given = files(spark, TEXTS + ["The the THE cat, a cat9 café cat", "of the and"]).filter("text IS NOT NULL")
    chunks = given.select(F.concat(F.col("doc_id").cast("string"), F.lit("::p1::c0")).alias("chunk_id"), "doc_id", "text")
    counted = kw.chunk_terms(chunks)
    assert "Exchange hashpartitioning(chunk_id" not in counted._jdf.queryExecution().toString()
    assert rows(counted.drop("doc_id")) == rows(kw.term_frequency(chunks))
    assert rows(kw.chunk_lengths(chunks).drop("doc_id")) == rows(kw.doc_lengths(chunks))
    one = [r["term"] for r in kw.chunk_terms(chunks.filter("doc_id = 4").coalesce(1)).collect()]
    assert one == sorted(one) and len(one) > 2


def test_stored_search_shuffles_hits_and_not_their_queries(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    texts = [f"common word number {i} of {i % 3} kinds" for i in range(12)]
    for part in (1, 0):
        plan.store_batch(files(spark, texts).filter(F.col("doc_id") % 2 == part), folder, size=200, overlap=0)
    questions = spark.createDataFrame([(1, "common number 4"), (2, "word kinds kinds"), (3, "none such")], "query_id bigint, text string")
    chunks = st.read_store(spark, f"{folder}/chunks")
    want = rows(kw.bm25_topk(chunks, questions, 3))
    # Nothing stored of a document meets an older row of it, so no key is grouped to find the last one.
    assert "max_by" not in st.read_store(spark, f"{folder}/postings", ["chunk_id", "term"])._jdf.queryExecution().toString()
    terms = kw.query_terms(questions)
    postings = st.read_store(spark, f"{folder}/postings", ["chunk_id", "term"])
    stats = kw.corpus_stats(st.read_store(spark, f"{folder}/lengths"))
    assert rows(kw.stored_topk(postings, stats, terms, 3, max_shipped=1)) == want  # too many terms to ship
    monkeypatch.setattr(kw, "bm25_scores", None)  # joins every hit with all its queries
    for few in (1000, 1):
        assert rows(plan.search_stored(spark, folder, questions, 3, few)) == want


def test_layers_that_name_whole_documents(spark, tmp_path):
    folder = str(tmp_path / "s")

    def batch(*pairs):
        return spark.createDataFrame([(f"{d}::{n}", d, x) for d, n, x in pairs], "chunk_id string, doc_id bigint, x string")

    def ids(*of):
        return spark.createDataFrame([(d,) for d in of], "doc_id bigint")

    def now():
        return sorted((r["chunk_id"], r["x"]) for r in st.read_store(spark, folder).collect())

    st.append(batch((1, 0, "a"), (1, 1, "b"), (2, 0, "c")), folder, ids(1, 2), whole=True)
    st.append(batch((1, 0, "A")), folder, ids(1), whole=True)
    assert now() == [("1::0", "A"), ("2::0", "c")]
    st.append(batch(), folder, ids(2), whole=True)
    assert now() == [("1::0", "A")]
    st.compact(spark, folder)
    st.append(batch((1, 2, "z"), (3, 0, "d")), folder, ids(1, 3), whole=True)
    assert now() == [("1::2", "z"), ("3::0", "d")]
    st.append(batch((3, 0, "e"), (4, 0, "f")), folder)  # upserts alone: the last row of a key counts
    assert now() == [("1::2", "z"), ("3::0", "e"), ("4::0", "f")]
