import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusflow.functions.models import CHARACTERS, WORDS, hashed_embedding
from corpusflow.operators import chunking as ch
from corpusflow.functions import text as tx


def pack_plain(pieces, budget):
    out, cur = [], ""
    for piece in pieces:
        if cur and len(cur + piece) > budget:
            out, cur = out + [cur], ""
        cur += piece
    return out + [cur] if cur else out


def test_pack(one):
    pieces = ["aaa ", "bb ", "cccccc", "d", "eeeeeeeeeeee"]
    assert one(lambda c: ch.pack(c, 8), pieces) == pack_plain(pieces, 8)


@pytest.mark.parametrize("measure", [CHARACTERS, WORDS])
def test_pieces_are_lossless_and_fit(spark, measure):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    limit = 300 if measure is CHARACTERS else 40
    text = tx.normalize(F.col("text"))
    pieces = docs.select(text.alias("t"), ch.split_pieces(text, limit, measure).alias("p"))
    checked = pieces.select(
        (F.array_join("p", "") == F.col("t")).alias("same"),
        F.forall("p", lambda x: measure.count(x) <= limit).alias("fits"),
    )
    assert checked.filter("NOT same OR NOT fits").count() == 0


@pytest.mark.parametrize("measure", [CHARACTERS, WORDS])
def test_chunks_never_exceed_the_budget(spark, measure):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    size, overlap = (400, 80) if measure is CHARACTERS else (60, 12)
    chunks = docs.select(F.explode(ch.split_text(F.col("text"), size, overlap, measure)).alias("c"))
    assert chunks.filter(measure.count(F.col("c")) > size).count() == 0
    assert chunks.count() > docs.count()


def test_overlap_repeats_whole_words(one):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    chunks = one(lambda c: ch.split_text(c, 20, 8), text)
    assert chunks[0] == "alpha beta"
    for before, after in zip(chunks, chunks[1:]):
        assert after.split()[0] in before.split()
    assert all(len(c) <= 20 for c in chunks)


def test_long_run_is_cut_blind(one):
    assert one(lambda c: ch.split_text(c, 4, 0), "x" * 10) == ["xxxx", "xxxx", "xx"]


def test_budget_is_checked():
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            ch.check_budget(size, overlap)


def test_table_parts_repeat_the_header(one):
    table = "| a |\n| --- |\n" + "\n".join(f"| {i} |" for i in range(10))
    parts = one(lambda c: ch.table_parts(c, 35), table)
    assert all(p.startswith("| a |\n| --- |\n") and len(p) <= 35 for p in parts)
    assert [line for p in parts for line in p.split("\n")[2:]] == table.split("\n")[2:]
    assert one(lambda c: ch.table_parts(c, 500), table) == [table]


def test_window_grows_left_then_right(one):
    sentences = ["aaaa", "bbbb", "cccc", "dddd", "eeee"]
    grow = lambda size, at: one(lambda c: ch.grown_window(c, F.lit(at), 2, size, CHARACTERS), sentences)
    assert grow(100, 2) == "aaaa bbbb cccc dddd eeee"
    assert grow(9, 2) == "bbbb cccc"
    assert grow(14, 0) == "aaaa bbbb cccc"
    assert grow(4, 2) == "cccc"


def runs_for(spark, size=80, headers=False):
    rows = [
        (1, 1, 1, "heading", "Intro", ["Intro"]),
        (1, 1, 2, "text", "First sentence here. Second sentence here. Third sentence here. Fourth sentence here.", ["Intro"]),
        (1, 1, 3, "table", "| a |\n| --- |\n| 1 |", ["Intro"]),
        (1, 1, 4, "text", "After the table.", ["Intro"]),
        (1, 1, 5, "text", "Other part.", ["Other"]),
        (1, 1, 6, "text", "Back again.", ["Intro"]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, block_no int, kind string, text string, section_path array<string>")
    return ch.text_runs(df, size, headers=headers)


def test_runs_keep_order_and_tables_apart(spark):
    got = [(r["section"], r["atomic"], r["text"][:12]) for r in runs_for(spark).orderBy("group_no").collect()]
    assert got == [
        ("Intro", False, "Intro\n\nFirst"), ("Intro", True, "| a |\n| --- "), ("Intro", False, "After the ta"),
        ("Other", False, "Other part."), ("Intro", False, "Back again."),
    ]


def test_strategies(spark):
    runs = runs_for(spark)
    plain = ch.chunk_with("recursive", runs, 10).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in plain] == [f"1::p1::c{i}" for i in range(len(plain))]
    assert all(r["embed_text"] == r["text"] and r["parent_id"] == "" for r in plain)
    parents = ch.chunk_with("parent_document", runs, 10).collect()
    assert all(len(r["embed_text"]) <= 64 and r["embed_text"] in r["text"] for r in parents)
    assert all(r["parent_id"].startswith("1::p1::s") for r in parents)
    windows = ch.chunk_with("sentence_window", runs, 10).collect()
    assert all(r["embed_text"] in r["text"] for r in windows)
    semantic = ch.chunk_with("semantic", runs, 10, embed=hashed_embedding).collect()
    assert {r["section"] for r in semantic} == {"Intro", "Other"}
    replies = spark.createDataFrame([("1/1/1/0", "- The first fact of this passage.")], "passage_id string, reply string")
    facts = ch.chunk_with("propositional", runs, 10, replies=replies).collect()
    assert [r["embed_text"] for r in facts if r["parent_id"]] == ["The first fact of this passage."]


def test_unknown_or_unsupported_strategy_is_an_error(spark):
    runs = runs_for(spark)
    for name in ("nope", "semantic", "propositional"):
        with pytest.raises(ValueError):
            ch.chunk_with(name, runs, 10)


def test_headers_are_reserved_out_of_the_budget(spark):
    chunks = ch.chunk_with("recursive", runs_for(spark, 60, headers=True), 10).collect()
    assert all(r["text"].startswith(f"[{r['section']}]\n\n") and len(r["text"]) <= 60 for r in chunks)


def test_header_falls_back_to_leaf_then_nothing(one):
    path = ["A very long outer heading", "Leaf"]
    assert one(lambda c: ch.section_header(c, 200), path) == "[A very long outer heading > Leaf]\n\n"
    assert one(lambda c: ch.section_header(c, 40), path) == "[Leaf]\n\n"
    assert one(lambda c: ch.section_header(c, 20), path) == ""


def test_context_line(one):
    line = lambda reply, n: one(lambda c: ch.context_line(c, n), reply)
    assert line('"About  pumps."', 50) == "About pumps."
    assert line("About pumps. And much more text here", 15) == "About pumps."
    assert line("One unbroken sentence that is too long", 10) == ""


ODD = [
    "", " ", "Dr. Who came. He left. and so on. Then A. B. went!? \"Yes.\" No... maybe. 1.2.3. Next",
    "a\r\nb\rc\n\n\n\nd \t e f\x85g h. Été came. été left. ⓐ x. (ʰ y. I.E. Z. VİZ. Q. no. 5",
    ". starts here. \x00 marked. Then more! ok", "x" * 70 + " " + "y" * 9 + ". " + "z" * 30, "v1.2a3. Then.\n" * 30,
    "one two three\n\nfour five. Six seven eight nine ten.\n" * 5,
]


@pytest.mark.parametrize("size, overlap", [(1, 0), (5, 2), (13, 12), (64, 0), (120, 30)])
def test_texts_are_cut_in_workers_as_by_columns(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "i int, t string")
    cut = df.select("t", ch.cut_text(F.col("t"), size, F.lit(overlap)).alias("a"), ch.split_text(F.col("t"), size, F.lit(overlap)).alias("b"))
    assert all(r["a"] == r["b"] for r in cut.collect())


def test_documents_are_cut_in_workers_as_by_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for size, overlap in ((500, 80), (64, 0)):
        cut = docs.select(ch.cut_text(F.col("text"), size, overlap).alias("a"), ch.split_text(F.col("text"), size, overlap).alias("b"))
        assert cut.filter("NOT a <=> b").count() == 0


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strategies_of_a_query_share_their_runs(spark):
    plan = executed(contract.queries()["chunk_strategy_select"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan  # the runs' windows are not in each strategy's plan
    # The runs of one, and parents and children of the other.
    assert plan.count("ArrowEvalPython [_cut_characters") == 3


def test_replies_are_cleaned_without_a_second_cut(spark):
    plan = executed(contract.queries()["propositional_chunks"](spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython [_cut_characters") == 1


def test_replies_meet_their_passages_only(spark):
    runs = spark.createDataFrame(
        [("a/1", 1, 1, 1, "", "", 40, False, "One short sentence. " * 4), ("a", 1, 1, 2, "", "", 40, True, "| a |")],
        "doc_id string, page_no int, run_no int, group_no int, section string, header string, body int, atomic boolean, text string",
    )
    fact = "- A fact of twenty-odd letters.\n- A fact that is too long for the forty letters of its group."
    replies = spark.createDataFrame([(key, fact) for key in ("a/1/1/1/1", "a/1/1/1/99", "a/1/2/0", "b/1/1/0", "")], "passage_id string, reply string")
    got = ch.chunk_with("propositional", runs, 10, replies=replies).orderBy("doc_id", "chunk_index").collect()
    assert [r["embed_text"] for r in got if r["parent_id"]] == ["A fact of twenty-odd letters."]
    assert len(got) == len({r["chunk_id"] for r in got}) and "| a |" in {r["embed_text"] for r in got}
