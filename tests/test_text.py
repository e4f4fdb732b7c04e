import pytest
from pyspark.sql import functions as F

from corpusflow.functions import scalars as sc
from corpusflow.functions import text as tx
from corpusflow.operators import sizing
from corpusflow.operators.replies import clean_propositions, clean_variants


def test_tokens_drop_stop_words_and_punctuation(one):
    assert one(tx.tokens, "What is the ERR-4021 code, v2.1?") == ["err", "4021", "code", "v2", "1"]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Dr. Smith left. He ran.", ["Dr. Smith left. ", "He ran."]),
        ("J. R. Tolkien wrote. Then slept.", ["J. R. Tolkien wrote. ", "Then slept."]),
        ("It ends in 2. Next one", ["It ends in 2. ", "Next one"]),
        ("Version 1.2.3. Next", ["Version 1.2.3. Next"]),
        ("Wait... and then. What?! Yes", ["Wait... and then. ", "What?! ", "Yes"]),
        ('He said "stop!" Then left.', ['He said "stop!" ', "Then left."]),
        ("no end", ["no end"]),
        ("mark\x00inside. Kept whole.", ["mark\x00inside. ", "Kept whole."]),
    ],
)
def test_sentences(one, text, parts):
    assert one(tx.sentences, text) == parts
    assert "".join(parts) == text


def test_normalize(one):
    assert one(tx.normalize, "  a\t b \r\n\r\n\n\n c  ") == "a b\n\nc"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2026-03-02", "2026-03-02"),
        ("2026-03-02T23:30:00-05:00", "2026-03-02"),
        ("2026-03-02T12:00:00Z", "2026-03-02"),
        ("02/03/2026", "2026-03-02"),
        ("2 March 2026", "2026-03-02"),
        ("March 2, 2026", "2026-03-02"),
        ("2026/03/02", "2026-03-02"),
        ("2026", None),
        ("last spring", None),
        ("", None),
    ],
)
def test_iso_date(one, value, expected):
    assert one(sc.iso_date, value) == expected


def test_title_prefers_real_titles(one):
    resolve = sc.resolve_title
    assert one(resolve, "Annual report", "Intro", "a.pdf") == "Annual report"
    assert one(resolve, "Microsoft Word - x.doc", "Intro", "a.pdf") == "Intro"
    assert one(resolve, "draft.docx", "", "folder/plan.v2.pdf") == "plan.v2"
    assert one(resolve, "Untitled", "", "") == "Untitled"


def test_states_value_compares_whole_tokens(one):
    assert one(sc.states_value, "The total is £84.50.", "84,50")
    assert not one(sc.states_value, "The total is 84.50.", "50")
    assert one(sc.states_value, "Sold by ACME Ltd", "acme")


def test_refusal_needs_hedge_without_number(one):
    assert one(sc.is_refusal, "There is no visible text in the photo.")
    assert not one(sc.is_refusal, "I couldn't read it clearly, but the total is 84.50")
    assert not one(sc.is_refusal, "The total is 84.50")


def test_unverified_values(one):
    answer = "Total £1,234.56 on 2026-03-11, see [E12], twice 99 and 99, digit 7"
    assert one(sc.unverified_values, answer, "1234.567 and 11 March") == ["2026-03-11", "99"]
    assert one(sc.unverified_values, answer, None) == ["£1,234.56", "2026-03-11", "99"]


def test_pipe_table_pads_and_escapes(one):
    table = one(lambda r: sc.pipe_table(r), [["a", "b|c"], ["1"]])
    assert table == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_rewrite_guard(one):
    assert one(sc.rewrite_or_original, 'Here it is:\n\n "a question"\nmore', "orig") == "a question"
    assert one(sc.rewrite_or_original, "x" * 401, "orig") == "orig"
    assert one(sc.rewrite_or_original, None, "orig") == "orig"


def test_snippet(one):
    text = "a" * 60 + "Needle" + "b" * 60
    assert one(lambda c: tx.snippet(c, F.lit("needle")), text) == "…" + "a" * 40 + "Needle" + "b" * 40 + "…"
    assert one(lambda c: tx.snippet(c, F.lit("zzz")), text) == text[:80]


def test_variants_are_distinct_and_capped(spark):
    rows = [(1, "How do I reset it?", "1. How do I reset it\n2) Reset steps?\n- reset STEPS\n* Restore defaults\nThird one\nFourth")]
    got = clean_variants(spark.createDataFrame(rows, "query_id int, question string, reply string"), 3)
    assert [r["text"] for r in got.orderBy("variant_no").collect()] == ["Reset steps?", "Restore defaults", "Third one"]


def test_propositions_are_cleaned(spark):
    reply = "- The pump was replaced in 2019.\nshort\n3. The tank holds forty litres of oil."
    rows = spark.createDataFrame([("p", reply)], "passage_id string, reply string")
    got = [r["proposition"] for r in clean_propositions(rows).orderBy("prop_no").collect()]
    assert got == ["The pump was replaced in 2019.", "The tank holds forty litres of oil."]


def test_strip_takes_every_space_and_nothing_else(one):
    each = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert sorted(tx.EACH_SPACE) == sorted(each)
    text = each + "a" + each + "\u200bé" + each
    assert one(tx.strip, text) == "a" + each + "\u200bé" and one(tx.rstrip, text) == each + "a" + each + "\u200bé"
    assert one(tx.strip, each) == "" and one(tx.rstrip, each) == "" and one(tx.strip, None) is None


def test_a_task_works_on_a_bounded_share_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(sizing, "TASK_BYTES", 1000)
    for n in (10, 100):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).coalesce(1)
        got = sizing.spread(rows, "text", "doc_id")
        assert got.rdd.getNumPartitions() == max(n, spark.sparkContext.defaultParallelism) and got.count() == n
    assert sizing.spread(rows.limit(0), "text", "doc_id").count() == 0
