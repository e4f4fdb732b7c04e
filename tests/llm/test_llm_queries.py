"""Registered queries over the small tables, against their SQL, and the pipeline."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from check import connect, rows_of  # noqa: E402
from corpusflow.llm.queries import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = connect(DATA).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_pipeline_stages(spark):
    given = spark.createDataFrame(
        [(1, "eins zwei drei", "de", 1, 0), (2, "eins zwei drei", "de", 2, 0), (3, None, "en", 3, 0), (4, "123", "en", 4, 0),
         (5, "one two three four", "en", 5, 0), (5, "one two three four", "en", 6, 0), (None, "six seven", "en", 7, 0)],
        "doc_id long, text string, lang string, _key long, kept long",
    )
    kept = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == given.columns, name
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("2", "eins zwei drei"), ("5", "one two three four"), ("None", "six seven")]
    empty = given.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_pipeline_equals_its_stages(spark):
    """Whole run on the small table: brute-force dedup, then every kept document is packed."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    latest = {}
    for r in docs.collect():
        if any(c.isalpha() for c in r.text or ""):
            latest[r.text] = max(latest.get(r.text, r.doc_id), r.doc_id)
    packed = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    assert packed <= set(latest.values()) and len(packed) >= 0.97 * len(latest)
