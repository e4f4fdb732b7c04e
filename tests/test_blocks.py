from pyspark.sql import functions as F

from corpusflow.operators import blocks as bl
from corpusflow.sources import files as fi


def blocks_of(df):
    rows = df.orderBy("doc_id", "block_no").collect()
    return [(r["kind"], r["text"], r["level"]) for r in rows]


def lines(spark, text):
    return blocks_of(bl.line_blocks(spark.createDataFrame([(1, text)], "doc_id bigint, text string")))


def test_markdown_blocks(spark):
    text = "# Title #\nfirst line  \nsecond\n\nSub\n---\n| a | b |\n|---|---|\n| 1 | 2 |\n- item\n---\n| lone |"
    assert lines(spark, text) == [
        ("heading", "Title", 1),
        ("text", "first line\nsecond", None),
        ("heading", "Sub", 2),
        ("table", "| a | b |\n|---|---|\n| 1 | 2 |", None),
        ("text", "- item\n---", None),
        ("text", "| lone |", None),
    ]


def test_fence_closes_with_its_own_marker(spark):
    text = "a\n```py\n# not a heading\n~~~\nx\n```\n# Real\n~~~\n```\nopen to the end"
    assert lines(spark, text) == [
        ("text", "a", None),
        ("text", "```py\n# not a heading\n~~~\nx\n```", None),
        ("heading", "Real", 1),
        ("text", "~~~\n```\nopen to the end", None),
    ]


def test_setext_underline_is_used_once(spark):
    assert lines(spark, "A\n===\n===\nB") == [("heading", "A", 1), ("text", "===\nB", None)]


def test_front_matter(spark, one):
    text = "---\nTitle: 'My: page'\n nested: no\n- item: no\ntitle: Last\n---\nbody"
    assert one(lambda c: bl.front_matter(c)[0], text) == {"title": "Last"}
    assert one(lambda c: bl.front_matter(c)[1], text) == "body"
    assert one(lambda c: bl.front_matter(c)[0], "---\nno end") == {}
    assert one(lambda c: bl.front_matter(c)[1], "---\nno end") == "---\nno end"


def test_html_blocks(spark):
    html = (
        "<html><head><title>t</title></head><body><script>var a='</p>';</script><h2>Plan &amp; more</h2>"
        "<p>One<br>two &#233;&lt;b&gt; &eacute; &amp;lt;</p><!-- <p>gone</p> -->"
        "<table><tr><th>k</th><th>v</th></tr><tr><td><p>1</p></td><td>x|y</td></tr><tr><td> </td></tr></table>tail"
    )
    got = blocks_of(bl.html_blocks(spark.createDataFrame([(1, html)], "doc_id bigint, html string")))
    assert got == [
        ("heading", "Plan & more", 2),
        ("text", "One", None),
        ("text", "two é<b> é &lt;", None),
        ("table", "| k | v |\n| --- | --- |\n| 1 | x\\|y |", None),
        ("text", "tail", None),
    ]


def test_html_head_first_value_wins(spark):
    html = (
        "<head><meta name='Author' content=' Ann '><meta property=\"og:title\" content=\"A &amp; B\">"
        "<title> My \n page </title><meta name=author content='Bob'></head><body><meta name='x' content='y'>"
    )
    fields = bl.html_head(spark.createDataFrame([(1, html)], "doc_id bigint, html string")).first()["fields"]
    assert fields == {"author": "Ann", "og:title": "A & B", "title": "My page"}


def structured(spark, rows):
    df = spark.createDataFrame(
        [(1, p, b, k, t, lv) for p, b, k, t, lv in rows],
        "doc_id int, page_no int, block_no int, kind string, text string, level int",
    )
    return bl.section_paths(bl.detect_headings(df)).orderBy("page_no", "block_no").collect()


def test_sections_carry_across_pages_and_close(spark):
    got = structured(
        spark,
        [
            (1, 1, "heading", "Report", 2),
            (1, 2, "heading", "Methods", 3),
            (2, 1, "text", "body text ends.", None),
            (2, 2, "heading", "Results", 3),
            (2, 3, "heading", "Appendix", 2),
        ],
    )
    assert [r["section_path"] for r in got] == [
        ["Report"], ["Report", "Methods"], ["Report", "Methods"], ["Report", "Results"], ["Appendix"],
    ]


def test_skipped_level_does_not_nest(spark):
    # Two level-3 headings under a level-1 heading stay siblings.
    got = structured(
        spark, [(1, 1, "heading", "A", 1), (1, 2, "heading", "X", 2), (1, 3, "heading", "B", 1), (1, 4, "heading", "C", 3), (1, 5, "heading", "D", 3)]
    )
    assert [r["section_path"] for r in got][-2:] == [["B", "C"], ["B", "D"]]


def test_heading_signals(one):
    def check(text, size=None, body=None, kind="text"):
        none = F.lit(None).cast("double")
        return one(
            lambda c: bl.is_heading(c, F.lit(kind), none if size is None else F.lit(size), none if body is None else F.lit(body)), text
        )

    assert check("3.1 Sampling")
    assert check("Chapter 4")
    assert not check("1. Rinse the sample thoroughly.")
    assert check("SUMMARY")
    assert not check("500")
    assert check("Ends with a stop.", 14.0, 10.0)
    assert not check("SUMMARY", 10.0, 10.0)
    assert not check("SUMMARY", kind="table")
    assert not check("3.1 " + "x" * 120)


def test_boilerplate(spark):
    rows = []
    for page in range(4):
        rows += [(1, page, 0, f"ACME  Report {page}", True), (1, page, 1, f"body {page % 2}", False), (1, page, 2, f"Page {page} of 4", True)]
    rows += [(2, 9, 0, "Only page", True), (2, 9, 1, "- 12 -", True)]
    df = spark.createDataFrame(rows, "group_id int, page_id int, line_no int, line string, margin boolean")
    kept = {(r["group_id"], r["line"]) for r in bl.without_boilerplate(df).collect()}
    assert kept == {(1, "body 0"), (1, "body 1"), (2, "Only page")}


def test_delimited_files(spark):
    text = 'name;note\r\n"Ann; A";"two\nlines"\n\n;\nBob;"say ""hi"""\n'
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert df.select(fi.delimited_rows(F.col("text"))).first()[0] == [
        ["name", "note"], ["Ann; A", "two lines"], ["Bob", 'say "hi"'],
    ]
    many = "a,b\n" + "\n".join(f"{i},{i}" for i in range(45))
    got = blocks_of(fi.delimited_blocks(spark.createDataFrame([(1, many)], "doc_id bigint, text string")))
    assert [len(text.split("\n")) for _, text, _ in got] == [22, 22, 7]
    assert all(text.startswith("| a | b |\n| --- | --- |") for _, text, _ in got)
    only = blocks_of(fi.delimited_blocks(spark.createDataFrame([(1, "a\tb")], "doc_id bigint, text string")))
    assert only == [("table", "| a | b |\n| --- | --- |", None)]


def test_decoding(spark):
    rows = [("﻿é".encode(), "é"), ("naïve".encode("utf-8"), "naïve"), ("“x” €".encode("cp1252"), "“x” €"), (b"a\x81\x93", "a\x81\x93")]
    df = spark.createDataFrame([(bytearray(raw), want) for raw, want in rows], "content binary, want string")
    assert [r[0] == r[1] for r in df.select(fi.decode_bytes(F.col("content")), "want").collect()] == [True] * 4


def test_files_are_read_and_judged(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.md").write_text("")
    got = {r["filename"]: r["reject_reason"] for r in fi.admit(fi.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.TXT": None, "b.exe": "Unsupported file type '.exe'.", "c.md": "File is empty."}


def test_character_references_of_any_form(one):
    text = "&apos;&check;&#0000000000065;&#x00000000042;&amp;lt;&notareference;&AMP;"
    assert one(bl.unescape, text) == "'✓AB&lt;&notareference;&"


def test_coded_files_fail_with_a_reason(spark):
    from corpusflow.plans.ingest import NO_READER, ingest

    rows = [(1, "a.pdf", "%PDF-1.4 words and words", 20), (2, "b.txt", "Some words in a text.", 20)]
    _, registry = ingest(spark.createDataFrame(rows, "doc_id bigint, filename string, text string, n_bytes bigint"))
    got = {r["doc_id"]: (r["status"], r["failure_reason"]) for r in registry.collect()}
    assert got == {1: ("FAILED", NO_READER), 2: ("READY", None)}
