"""Every query has a callable; a cross-section is compared with its SQL."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
from check import connect, rows_of  # noqa: E402

DATA = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_topk", "hybrid_search", "filtered_search", "html_page_blocks", "section_path", "overlap_carry", "table_row_split",
    "compaction_slice", "document_registry", "chunk_upsert", "evidence_labels", "interval_sample", "session_context_stream",
    "retrieval_metrics", "ingest_corpus",
]


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, DATA).toPandas()
    want = connect(DATA).execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
