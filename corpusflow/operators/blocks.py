"""Raw text and HTML -> ordered blocks; headings, levels and section paths.

Blocks are rows ``doc_id, page_no, block_no, kind, text, level``. Windows are
per document; one document is one input row, so a window never holds more than
one row of the source table.
"""

from __future__ import annotations

import functools
import html.entities
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import cutting, lines
from corpusflow.functions import text as tx
from corpusflow.functions.scalars import pipe_table
from corpusflow.session import staged

# Fixed values ---------------------------------------------------------------
SKIPPED_TAGS = ("script", "style", "head", "noscript", "template", "svg")
BOUNDARY_TAGS = (
    "p", "div", "section", "article", "header", "footer", "main", "aside", "li", "dd", "dt",
    "blockquote", "pre", "figcaption", "hr", "br",
)
HEADING_MAX_CHARS = 120
HEADING_MAX_LINES = 2
HEADING_SIZE_RATIO = 1.1
FONT_STEP = 0.5
MAX_LEVEL = 6
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+\S"
NAMED_DIVISION = r"(?i)^(?:chapter|section|part|appendix)\s+(?:\d+|[ivxlc]+|[a-z])\b"
PAGE_NUMBER = r"(?i)^[\-–—\s]*(?:page\s+)?\d+\s*(?:of\s+\d+)?[\-–—\s]*$"
# End of fixed values --------------------------------------------------------

CUT = "\x01"
TABLE_MARK = "\x02"
ROW = "\x03"
CELL = "\x04"
MARKS = f"[{CUT}{TABLE_MARK}{ROW}{CELL}]"


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


# HTML ------------------------------------------------------------------------


# References that make up nearly all text, replaced without looking anything up.
COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0"}
REFERENCE = "&(?!amp;)#?[A-Za-z0-9]+;"


@functools.cache
def _entity_table() -> str:
    """JSON of every named reference but ``&amp;``, by its first two letters."""
    table: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        if name.endswith(";") and name != "amp;":
            table.setdefault(name[:2], {})[f"&{name}"] = value
    return json.dumps(table)


def unescape(text: Column) -> Column:
    """Character references to characters; ``&amp;`` last, so once only."""
    # One literal, parsed once by the optimizer; a reference is sought among those that begin like it.
    table = F.from_json(F.lit(_entity_table()), "map<string,map<string,string>>")

    def character(ref: Column) -> Column:
        hexed = F.regexp_extract(ref, "^&#[xX]0*([0-9A-Fa-f]{1,6});$", 1)
        decimal = F.regexp_extract(ref, "^&#0*([0-9]{1,7});$", 1)
        code = F.when(hexed != "", hexed).when(decimal != "", F.conv(decimal, 10, 16))
        numbered = F.coalesce(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), ref)
        named = F.coalesce(table[F.substring(ref, 2, 2)][ref], ref)
        return F.when(F.startswith(ref, F.lit("&#")), numbered).otherwise(named)

    def rarer(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
        return F.aggregate(found, text, lambda acc, ref: F.replace(acc, ref, character(ref)))

    # Every reference of the source is found before any is replaced, so that no replacement makes a new one.
    usual = text
    for ref, value in COMMON.items():
        usual = F.replace(usual, F.lit(ref), F.lit(value))
    others = REFERENCE.replace("amp;", "(?:amp|lt|gt|quot|#39|apos|nbsp);")
    plain = F.when(F.regexp_like(text, F.lit(others)), rarer(text)).otherwise(usual)
    return F.when(F.contains(text, F.lit("&")), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def _drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, "</?[A-Za-z!?][^>]*>", "")


def _plain(markup: Column) -> Column:
    """The text of markup. The array of one names the tagless text, which is read several times."""
    return F.transform(F.array(_drop_tags(markup)), unescape)[0]


def _table_text(segment: Column) -> Column:
    """Pipe table of one table's markup; rows without text are left out."""
    marked = F.regexp_replace(segment, r"(?i)<tr\b[^>]*>", ROW)
    marked = F.regexp_replace(marked, r"(?i)<t[dh]\b[^>]*>", CELL)
    rows = F.transform(
        F.split(marked, ROW),
        lambda row: F.transform(
            F.slice(F.split(row, CELL), 2, F.greatest(F.size(F.split(row, CELL)) - 1, F.lit(0))),
            lambda cell: tx.collapse(_plain(cell)),
        ),
    )
    return pipe_table(F.filter(rows, lambda row: F.exists(row, lambda cell: cell != "")))


def html_blocks(pages: DataFrame) -> DataFrame:
    """``doc_id, html`` -> blocks: headings, paragraphs and pipe tables."""
    text = F.regexp_replace(F.col("html"), MARKS, " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    for tag in SKIPPED_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    text = F.regexp_replace(text, r"(?is)<table\b[^>]*>", CUT + TABLE_MARK)
    text = F.regexp_replace(text, r"(?i)</table\s*>", CUT)
    segments = pages.select("doc_id", F.posexplode(F.split(text, CUT)).alias("seg_no", "segment"))
    body = F.regexp_replace("segment", r"(?i)<h([1-6])\b[^>]*>", CUT + "$1")
    body = F.regexp_replace(
        body, rf"(?i)</h[1-6]\s*>|</?(?:{'|'.join(BOUNDARY_TAGS)})\b[^>]*>", CUT + "0"
    )
    is_table = F.col("segment").startswith(TABLE_MARK)

    def part(text: Column) -> Column:
        return F.struct(
            F.left(text, F.lit(1)).cast("int").alias("lv"),
            tx.collapse(_plain(F.substring(text, F.lit(2), F.length(text)))).alias("text"),
        )

    table = F.array(F.struct(F.lit(None).cast("int").alias("lv"), _table_text(F.col("segment")).alias("text")))
    prose = F.transform(F.split(F.concat(F.lit("0"), body), CUT), part)
    # Cleaned inside the generator, so that the filter below reads a finished
    # column instead of cleaning every part a second time.
    parts = segments.select(
        "doc_id", "seg_no", F.posexplode(F.when(is_table, table).otherwise(prose)).alias("part_no", "p")
    ).select("doc_id", "seg_no", "part_no", "p.lv", "p.text")
    order = Window.partitionBy("doc_id").orderBy("seg_no", "part_no")
    return parts.filter("text <> ''").select(
        "doc_id",
        F.lit(1).alias("page_no"),
        F.row_number().over(order).alias("block_no"),
        F.when(F.col("lv").isNull(), "table").when(F.col("lv") > 0, "heading").otherwise("text").alias("kind"),
        "text",
        F.when(F.col("lv") > 0, F.col("lv")).alias("level"),
    )


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"(?i)[\s/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return unescape(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def html_head(pages: DataFrame) -> DataFrame:
    """``doc_id, fields``: title and meta values before the body, first one wins."""
    head = F.regexp_replace(F.col("html"), r"(?is)<body\b.*$", "")
    title = tx.collapse(unescape(F.regexp_extract(head, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    title_at = F.regexp_instr(head, F.lit(r"(?is)<title\b"))
    metas = F.transform(
        F.regexp_extract_all(head, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
        lambda tag: F.struct(
            F.lower(tx.strip(F.when(_attribute(tag, "name") != "", _attribute(tag, "name")).otherwise(_attribute(tag, "property")))).alias("key"),
            tx.strip(_attribute(tag, "content")).alias("value"),
        ),
    )
    # A meta named "title" only wins over <title> when it stands before it.
    early = F.filter(metas, lambda e: (e["key"] != "title") | (F.instr(F.lower(head), "<meta") < title_at))
    entries = F.concat(
        F.filter(early, lambda e: e["key"] == "title"),
        F.array(F.struct(F.lit("title").alias("key"), title.alias("value"))),
        F.filter(metas, lambda e: e["key"] != "title"),
    )
    usable = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))
    with_entries = pages.select("doc_id", usable.alias("entries"))
    keys = F.transform("entries", lambda e: e["key"])
    first = F.filter("entries", lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return with_entries.select("doc_id", F.map_from_entries(first).alias("fields"))


# Front matter and text lines ---------------------------------------------------


def front_matter(text: Column) -> tuple[Column, Column]:
    """``(fields, body)`` of a text; no closing fence means no front matter."""
    unix = F.when(F.contains(text, F.lit("\r")), unix_lines(text)).otherwise(text)
    pattern = (
        rf"(?s)\A{tx.HORIZONTAL}*---{tx.HORIZONTAL}*\n((?:.*?\n)??)"
        rf"{tx.HORIZONTAL}*(?:---|\.\.\.){tx.HORIZONTAL}*(?:\n|\z)"
    )
    has = unix.rlike(pattern)
    lines = F.split(F.regexp_extract(unix, pattern, 1), "\n")
    pairs = F.filter(
        F.transform(
            F.filter(lines, lambda l: F.contains(l, F.lit(":")) & ~l.rlike("^[ \t-]")),
            lambda l: F.struct(
                F.lower(tx.strip(F.substring_index(l, ":", 1))).alias("key"),
                F.regexp_replace(
                    tx.strip(F.regexp_replace(l, "^[^:]*:", "")), "^[\"']+|[\"']+$", ""
                ).alias("value"),
            ),
        ),
        lambda p: p["key"] != "",
    )
    keys = F.transform(F.reverse(pairs), lambda p: p["key"])
    last_wins = F.filter(F.reverse(pairs), lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    fields = F.when(has, F.map_from_entries(last_wins)).otherwise(F.create_map().cast("map<string,string>"))
    # Cut off by length: replacing would go on looking through the whole text.
    front = F.length(F.regexp_extract(unix, pattern, 0))
    body = F.when(has, F.substring(unix, front + 1, F.length(unix))).otherwise(text)
    return fields, body


# What may be more than a paragraph: fences, headings, underlines, tables, front matter, and the marks used here.
STRUCTURE = rf"(?m)^{tx.HORIZONTAL}*+(?:[#|=]|--|```|~~~)|{MARKS}"


def plain_text(text: Column) -> Column:
    """The paragraphs of a text that is nothing but paragraphs, blank lines between them; NULL for any other text.

    ``line_blocks`` makes every paragraph of such a text one block without a
    heading, so the text needs no windows over its lines.
    """
    unix = F.when(F.contains(text, F.lit("\r")), unix_lines(text)).otherwise(text)
    lines = F.array_join(F.transform(F.split(unix, "\n"), tx.rstrip), "\n")
    paragraphs = F.filter(F.transform(F.split(lines, "\n{2,}"), tx.strip), lambda p: p != "")
    unsized = F.lit(None).cast("double")

    def joined(parts: Column) -> Column:
        headed = F.exists(parts, lambda p: is_heading(p, F.lit("text"), unsized, unsized))
        return F.when(~headed, F.array_join(parts, "\n\n"))

    # The array of one names the paragraphs, which are read twice.
    return F.when(~text.rlike(STRUCTURE), F.transform(F.array(paragraphs), joined)[0])


BLOCK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])


def _block_array(blocks: list[lines.Block]) -> pa.Array:
    kinds, texts, levels = ([block[n] for block in blocks] for n in range(3))
    parts = [pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(levels, pa.int32())]
    return pa.StructArray.from_arrays(parts, BLOCK.names)


@F.arrow_udf(T.ArrayType(BLOCK))
def _blocks_of(texts: pa.Array) -> pa.Array:
    return cutting.lists((None if t is None else lines.line_blocks(t) for t in cutting.strings(texts)), _block_array)


def line_blocks(texts: DataFrame) -> DataFrame:
    """``doc_id, text`` -> blocks of Markdown or plain text.

    The lines of a text stay in its row, so they need neither windows nor sorts.
    """
    blocks = texts.select("doc_id", F.posexplode(_blocks_of(F.col("text"))).alias("pos", "block"))
    return blocks.select(
        "doc_id", F.lit(1).alias("page_no"), (F.col("pos") + 1).alias("block_no"), "block.kind", "block.text", "block.level"
    )


# Headings ----------------------------------------------------------------------


def numbering_depth(text: Column) -> Column:
    """Components of a heading's own number, 1 for named divisions, else NULL."""
    line = tx.collapse(text)
    number = F.regexp_extract(line, NUMBERED, 1)
    depth = F.least(F.size(F.split(number, r"\.")), F.lit(MAX_LEVEL))
    return F.when(number != "", depth).when(line.rlike(NAMED_DIVISION), 1)


def emphasised(text: Column) -> Column:
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & letters.rlike(r"^\p{Lu}+$")


def is_heading(text: Column, kind: Column, size: Column, body_size: Column) -> Column:
    """Short text set larger, or numbered, or shouting where sizes are unknown."""
    short = (F.length(text) <= HEADING_MAX_CHARS) & (F.size(F.split(text, "\n")) <= HEADING_MAX_LINES)
    larger = F.coalesce(size >= body_size * HEADING_SIZE_RATIO, F.lit(False))
    prose = tx.rstrip(text).rlike("[.,;:!?]$")
    weak = ~prose & (numbering_depth(text).isNotNull() | (body_size.isNull() & emphasised(text)))
    return (kind == "text") & short & (larger | weak)


def body_sizes(lines: DataFrame) -> DataFrame:
    """``doc_id, body_size``: the font size with the most characters."""
    rounded = (F.bround(F.col("font_size") / FONT_STEP) * FONT_STEP).alias("font_size")
    weights = lines.select("doc_id", rounded, F.length("line").alias("w")).groupBy("doc_id", "font_size").agg(
        F.sum("w").alias("w")
    )
    # Equal weights go to the smaller size, which is the body in practice.
    return weights.groupBy("doc_id").agg(
        F.max_by("font_size", F.struct(F.col("w"), -F.col("font_size"))).alias("body_size")
    )


def detect_headings(blocks: DataFrame) -> DataFrame:
    """Mark headings and give them levels, compacted per document.

    ``blocks`` may carry ``font_size`` and ``body_size``; declared headings
    (kind ``heading`` with a level) are facts and keep their level.
    """
    for name in ("font_size", "body_size"):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast("double"))
    declared = F.coalesce((F.col("kind") == "heading") & (F.col("level") > 0), F.lit(False))
    found = is_heading(F.col("text"), F.col("kind"), F.col("font_size"), F.col("body_size"))
    marked = blocks.withColumn("declared", declared).withColumn("found", ~F.col("declared") & found)
    sized = F.col("found") & F.col("font_size").isNotNull()
    by_size = Window.partitionBy("doc_id", sized).orderBy(F.col("font_size").desc())
    raw = (
        F.when(F.col("declared"), F.col("level"))
        .when(sized, F.least(F.dense_rank().over(by_size), F.lit(MAX_LEVEL)))
        .when(F.col("found"), F.coalesce(numbering_depth(F.col("text")), F.lit(1)))
    )
    return compact_levels(marked.withColumn("raw_level", raw)).select(
        "doc_id", "page_no", "block_no",
        F.when(F.col("level").isNotNull(), "heading").otherwise(F.col("kind")).alias("kind"),
        "text", "level",
    )


def compact_levels(blocks: DataFrame) -> DataFrame:
    """``raw_level`` renumbered 1..n per document without gaps, at most six."""
    # In reading order, so that the section paths need no other sort.
    document = Window.partitionBy("doc_id").orderBy("page_no", "block_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    used = F.array_sort(F.collect_set("raw_level").over(document))
    rank = F.least(F.array_position(used, F.col("raw_level")).cast("int"), F.lit(MAX_LEVEL))
    return blocks.withColumn("level", F.when(F.col("raw_level").isNotNull(), rank))


def section_paths(blocks: DataFrame) -> DataFrame:
    """Add ``section_path``: the open headings of every level, pages included.

    A heading of level N closes every section at N or deeper. For each level
    the latest heading counts unless a shallower one came after it.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "block_no")

    def latest(level: int) -> Column:
        heading = F.struct("page_no", "block_no", tx.collapse(F.col("text")).alias("h"))
        return F.max(F.when(F.col("level") == level, heading)).over(order)

    # Added at once, they are one pass over the blocks.
    out = blocks.withColumns({f"_h{level}": latest(level) for level in range(1, MAX_LEVEL + 1)})

    def place(level: int) -> Column:
        return F.struct(F.col(f"_h{level}.page_no"), F.col(f"_h{level}.block_no"))

    parts = []
    for level in range(1, MAX_LEVEL + 1):
        open_ = F.col(f"_h{level}").isNotNull()
        for above in range(1, level):
            open_ = open_ & (F.col(f"_h{above}").isNull() | (place(above) < place(level)))
        parts.append(F.when(open_, F.col(f"_h{level}.h")))
    path = F.filter(F.array(*parts), lambda h: h.isNotNull())
    return out.withColumn("section_path", path).drop(*[f"_h{n}" for n in range(1, MAX_LEVEL + 1)])


def first_headings(blocks: DataFrame) -> DataFrame:
    """``doc_id, heading``: the first heading in document order."""
    heads = blocks.filter((F.col("kind") == "heading") & (tx.strip(F.col("text")) != ""))
    return heads.groupBy("doc_id").agg(
        F.min_by(tx.collapse(F.col("text")), F.struct("page_no", "block_no")).alias("heading")
    )


def boilerplate_key(line: Column) -> Column:
    return F.regexp_replace(tx.fold(line), "[0-9]+", "#")


def without_boilerplate(lines: DataFrame, min_pages: int = 3, share: float = 0.6) -> DataFrame:
    """Drop margin lines that repeat across a group's pages, and page numbers.

    ``lines``: ``group_id, page_id, line_no, line, margin`` (null: no margin
    line). The lines are staged, so what makes them runs once; pages per key
    are counted with partial aggregation on (group, key, page), so a group that
    holds a third of all pages is still spread over many tasks. Only margin
    lines are joined, the others have no key to meet at.
    """
    lines = staged(lines)
    keyed = lines.filter("margin").withColumn("key", boilerplate_key(F.col("line")))
    per_page = keyed.filter("key <> ''").select("group_id", "page_id", "key").distinct()
    seen = per_page.groupBy("group_id", "key").agg(F.count(F.lit(1)).alias("n_seen"))
    pages = lines.select("group_id", "page_id").distinct().groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_pages")
    )
    repeated = (
        seen.join(pages, "group_id")
        .filter((F.col("n_pages") >= min_pages) & (F.col("n_seen") >= F.col("n_pages") * share))
        .select("group_id", "key")
    )
    number = F.coalesce(tx.strip(F.col("line")).rlike(PAGE_NUMBER), F.lit(False))
    kept = keyed.filter(~number).join(repeated, ["group_id", "key"], "left_anti").select(*lines.columns)
    return kept.unionByName(lines.filter(~F.coalesce("margin", F.lit(False))))
