"""Blocks, sections and chunks of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.catalog import sqlparts as sp
from corpusflow.catalog.registry import Tables, query
from corpusflow.functions import models, scalars
from corpusflow.functions import text as tx
from corpusflow.operators import blocks as bl
from corpusflow.operators import chunking as ch
from corpusflow.operators.replies import clean_propositions
from corpusflow.session import staged
from corpusflow.sources import files as fi

NL = "chr(10)"


def pages(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("doc_id"), "url", "html")


def texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text")


def marked_up(t: Tables) -> DataFrame:
    """Documents as Markdown: front matter, headings and tables are added, and every line is kept.

    Lines go in groups of eight. The markup made from them comes in order, and
    after its blank line come those lines that the markup does not hold whole.
    """

    def line(l, i):
        return (
            F.when(i % 8 == 1, F.concat(F.repeat(F.lit("#"), F.floor(i / 8).cast("int") % 3 + 1), F.lit(" "), F.left(l, F.lit(40))))
            .when(i % 8 == 2, "")
            .when(i % 8 == 3, F.left(l, F.lit(20)))
            .when(i % 8 == 4, "-----")
            .when(i % 8 == 5, F.concat(F.lit("| k | "), F.replace(F.left(l, F.lit(10)), F.lit("|"), F.lit("/")), F.lit(" |")))
            .when(i % 8 == 6, "|---|---|")
            .when(i % 8 == 7, "| v | x |")
            .when(i % 16 == 8, F.concat(F.lit("3."), i.cast("string"), F.lit(" "), F.left(l, F.lit(30))))
            .when(i % 32 == 16, "SUMMARY OF RESULTS")
            .otherwise(l)
        )

    head = F.concat(
        F.lit('---\nTitle: "'), F.col("source"), F.lit('"\nLang: '), F.col("lang"),
        F.lit("\n- skip: me\nauthor: a"), (F.col("doc_id") % 5).cast("string"), F.lit("\nLANG: "), F.col("lang"),
        F.lit("2\n---\n"),
    )
    def ordered(lines, made):
        def eight(g):
            dropped = F.when(g % 4 == 0, 1).otherwise(0)
            own = F.slice(lines, g * 8 + 1 + dropped, 8 - dropped)
            return F.concat(F.slice(made, g * 8 + 1, 3), own, F.slice(made, g * 8 + 4, 5))

        last = F.floor((F.size(lines) - 1) / 8).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), last), eight))

    lines = F.split("text", "\n")
    # The array of one names the two arrays, which are read for every eight lines.
    both = F.array(F.struct(lines.alias("lines"), F.transform(lines, line).alias("made")))
    body = F.transform(both, lambda x: F.array_join(ordered(x["lines"], x["made"]), "\n"))[0]
    return t.documents.select("doc_id", F.concat(head, body).alias("text"))


MD_LINES = f"""
raw AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS l,
         generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM documents),
md AS (
  SELECT doc_id, i // 8 * 16 + i % 8 + 3 AS i, l AS line FROM raw WHERE i % 32 <> 0 UNION ALL
  SELECT doc_id, i // 8 * 16 + i % 8 + CASE WHEN i % 8 <= 2 THEN 0 ELSE 8 END, CASE i % 8
    WHEN 1 THEN repeat('#', ((i // 8) % 3 + 1)::INT) || ' ' || left(l, 40)
    WHEN 2 THEN '' WHEN 3 THEN left(l, 20) WHEN 4 THEN '-----'
    WHEN 5 THEN '| k | ' || replace(left(l, 10), '|', '/') || ' |'
    WHEN 6 THEN '|---|---|' WHEN 7 THEN '| v | x |'
    ELSE CASE WHEN i % 16 = 8 THEN '3.' || i || ' ' || left(l, 30) WHEN i % 32 = 16 THEN 'SUMMARY OF RESULTS' ELSE l END END AS line
  FROM raw),
md_s AS (SELECT *, {sp.strip('line')} AS s FROM md),
md_next AS (
  SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM md_s),
md_cand AS (
  SELECT *, s <> '' AND NOT regexp_matches(s, '^[#\\-*+>|]')
    AND coalesce(regexp_matches(nxt, '^(=+|-{{2,}})\\s*$'), false) AS cand FROM md_next),
md_used AS (
  SELECT *, coalesce(lag(cand) OVER (PARTITION BY doc_id ORDER BY i), false) AS used FROM md_cand),
md_kind AS (
  SELECT *, CASE WHEN used THEN 'used' WHEN s = '' THEN 'blank'
    WHEN regexp_matches(s, '^(#{{1,6}})\\s+(.*?)\\s*#*\\s*$') THEN 'atx' WHEN cand THEN 'setext'
    WHEN regexp_matches(s, '^\\|.*\\|$') THEN 'table' ELSE 'text' END AS t FROM md_used),
md_open AS (
  SELECT *, CASE WHEN t IN ('atx', 'setext') OR lag(t) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM t
    THEN 1 ELSE 0 END AS opens FROM md_kind),
md_block AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM md_open),
md_text AS (
  SELECT doc_id, b, any_value(t) AS t,
    any_value(CASE WHEN t = 'atx' THEN length(regexp_extract(s, '^(#{{1,6}})\\s+(.*?)\\s*#*\\s*$', 1))
              WHEN t = 'setext' THEN CASE WHEN nxt LIKE '=%' THEN 1 ELSE 2 END END) AS level,
    list(CASE WHEN t = 'atx' THEN {sp.strip("regexp_extract(s, '^(#{1,6})\\s+(.*?)\\s*#*\\s*$', 2)")}
              WHEN t IN ('setext', 'table') THEN s
              ELSE regexp_replace(line, '{sp.SPACE}+$', '') END ORDER BY i) AS c
  FROM md_block WHERE t NOT IN ('blank', 'used') GROUP BY 1, 2),
mblocks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS block_no,
    CASE WHEN t IN ('atx', 'setext') THEN 'heading'
         WHEN t = 'table' AND len(c) > 1 AND regexp_matches(c[2], '^\\|[\\s:|-]+\\|$') THEN 'table' ELSE 'text' END AS kind,
    CASE WHEN t = 'text' THEN {sp.strip(f"array_to_string(c, {NL})")} ELSE array_to_string(c, {NL}) END AS text, level
  FROM md_text)"""


def markdown_blocks(t: Tables) -> DataFrame:
    source = marked_up(t)
    _, body = bl.front_matter(F.col("text"))
    return bl.line_blocks(source.select("doc_id", body.alias("text")))


@query("text_line_blocks", f"WITH {MD_LINES} SELECT doc_id, block_no, kind, text, level FROM mblocks")
def text_line_blocks(t: Tables) -> DataFrame:
    return markdown_blocks(t).select("doc_id", "block_no", "kind", "text", "level")


@query(
    "front_matter_fields",
    "SELECT doc_id, source AS title, lang || '2' AS lang, 'a' || doc_id % 5 AS author, 3 AS n_fields FROM documents",
)
def front_matter_fields(t: Tables) -> DataFrame:
    fields, _ = bl.front_matter(F.col("text"))
    found = marked_up(t).select("doc_id", fields.alias("f"))
    return found.select(
        "doc_id", F.col("f.title").alias("title"), F.col("f.lang").alias("lang"), F.col("f.author").alias("author"),
        F.size("f").alias("n_fields"),
    )


DROPS = "html"
DROPS = f"regexp_replace({DROPS}, '(?s)<!--.*?-->', '', 'g')"
for _tag in bl.SKIPPED_TAGS:
    DROPS = f"regexp_replace({DROPS}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
PAGE_BLOCKS = f"""
cut AS (
  SELECT page_id AS doc_id, regexp_replace(regexp_replace({DROPS},
    '(?i)<h([1-6])\\b[^>]*>', chr(1) || '\\1', 'g'),
    '(?i)</h[1-6]\\s*>|</?(?:{'|'.join(bl.BOUNDARY_TAGS)})\\b[^>]*>', chr(1) || '0', 'g') AS h FROM pages),
parts AS (
  SELECT doc_id, unnest(string_split('0' || h, chr(1))) AS p,
         generate_subscripts(string_split('0' || h, chr(1)), 1) AS i FROM cut),
clean AS (
  SELECT doc_id, i, left(p, 1)::BIGINT AS lv,
    {sp.collapse("replace(replace(replace(replace(regexp_replace(substr(p, 2), '</?[A-Za-z!?][^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')")} AS text
  FROM parts),
pblocks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block_no,
    CASE WHEN lv > 0 THEN 'heading' ELSE 'text' END AS kind, text, CASE WHEN lv > 0 THEN lv END AS level
  FROM clean WHERE text <> '')"""


def page_blocks(t: Tables) -> DataFrame:
    return bl.html_blocks(pages(t))


@query("html_page_blocks", f"WITH {PAGE_BLOCKS} SELECT doc_id, block_no, kind, text, level FROM pblocks")
def html_page_blocks(t: Tables) -> DataFrame:
    return page_blocks(t).select("doc_id", "block_no", "kind", "text", "level")


HEAD_TITLE = sp.collapse(
    "replace(replace(replace(replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), "
    "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
)


@query(
    "html_head_metadata",
    f"SELECT page_id AS doc_id, nullif({HEAD_TITLE}, '') AS title, "
    f"CASE WHEN {HEAD_TITLE} <> '' THEN 1 ELSE 0 END AS n_fields FROM pages",
)
def html_head_metadata(t: Tables) -> DataFrame:
    head = bl.html_head(pages(t))
    return head.select(
        "doc_id", scalars.first_key(F.col("fields"), scalars.TITLE_KEYS).alias("title"), F.size("fields").alias("n_fields")
    )


@query(
    "first_heading_title",
    f"WITH {PAGE_BLOCKS} SELECT doc_id, arg_min(text, block_no) AS heading FROM pblocks WHERE kind = 'heading' GROUP BY 1",
)
def first_heading_title(t: Tables) -> DataFrame:
    return bl.first_headings(page_blocks(t))


@query(
    "title_resolve",
    f"""WITH {PAGE_BLOCKS},
heads AS (SELECT doc_id, arg_min(text, block_no) AS heading FROM pblocks WHERE kind = 'heading' GROUP BY 1),
named AS (SELECT page_id AS doc_id, CASE page_id % 3 WHEN 0 THEN 'Microsoft Word - a.doc' WHEN 1 THEN {HEAD_TITLE} END AS embedded,
  regexp_extract(url, '([^/]*)/?$', 1) AS last FROM pages)
SELECT n.doc_id, CASE WHEN coalesce(embedded, '') <> '' AND n.doc_id % 3 = 1 THEN embedded
  WHEN coalesce(heading, '') <> '' THEN heading ELSE 'page-' || n.doc_id END AS title
FROM named n LEFT JOIN heads USING (doc_id)""",
)
def title_resolve(t: Tables) -> DataFrame:
    head = bl.html_head(pages(t)).select("doc_id", F.col("fields.title").alias("head_title"))
    joined = head.join(bl.first_headings(page_blocks(t)), "doc_id", "left")
    embedded = F.when(F.col("doc_id") % 3 == 0, "Microsoft Word - a.doc").when(F.col("doc_id") % 3 == 1, F.col("head_title"))
    filename = F.concat(F.lit("page-"), F.col("doc_id").cast("string"), F.lit(".html"))
    return joined.select("doc_id", scalars.resolve_title(embedded, F.col("heading"), filename).alias("title"))


LEVELED = f"""{MD_LINES},
found AS (
  SELECT *, {sp.collapse('text')} AS one, kind = 'heading' AND level > 0 AS declared FROM mblocks),
depth AS (
  SELECT *, CASE WHEN regexp_matches(one, '^(\\d+(?:\\.\\d+)*)\\.?\\s+\\S')
      THEN least(len(string_split(regexp_extract(one, '^(\\d+(?:\\.\\d+)*)\\.?\\s+\\S', 1), '.')), 6)
    WHEN regexp_matches(one, '(?i)^(?:chapter|section|part|appendix)\\s+(?:\\d+|[ivxlc]+|[a-z])\\b') THEN 1 END AS num,
    regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS letters FROM found),
head AS (
  SELECT *, NOT coalesce(declared, false) AND kind = 'text' AND length(text) <= 120 AND len(string_split(text, {NL})) <= 2
    AND NOT regexp_matches(regexp_replace(text, '{sp.SPACE}+$', ''), '[.,;:!?]$')
    AND (num IS NOT NULL OR (length(letters) >= 2 AND regexp_matches(letters, '^\\p{{Lu}}+$'))) AS hit FROM depth),
rawlv AS (
  SELECT *, CASE WHEN coalesce(declared, false) THEN level WHEN hit THEN coalesce(num, 1) END AS raw_level FROM head),
leveled AS (
  SELECT *, CASE WHEN raw_level IS NOT NULL THEN
    least(dense_rank() OVER (PARTITION BY doc_id, raw_level IS NOT NULL ORDER BY raw_level), 6) END AS lv FROM rawlv)"""


@query(
    "heading_detection",
    f"WITH {LEVELED} SELECT doc_id, block_no, text FROM leveled WHERE hit",
)
def heading_detection(t: Tables) -> DataFrame:
    blocks = markdown_blocks(t)
    none = F.lit(None).cast("double")
    hit = bl.is_heading(F.col("text"), F.col("kind"), none, none)
    return blocks.filter(hit).select("doc_id", "block_no", "text")


@query(
    "level_compaction",
    f"WITH {LEVELED} SELECT doc_id, block_no, raw_level, lv AS level FROM leveled WHERE lv IS NOT NULL",
)
def level_compaction(t: Tables) -> DataFrame:
    declared = F.when(F.col("kind") == "heading", F.col("level"))
    none = F.lit(None).cast("double")
    guessed = F.when(
        bl.is_heading(F.col("text"), F.col("kind"), none, none), F.coalesce(bl.numbering_depth(F.col("text")), F.lit(1))
    )
    ranked = bl.compact_levels(markdown_blocks(t).withColumn("raw_level", F.coalesce(declared, guessed)))
    return ranked.filter("level IS NOT NULL").select("doc_id", "block_no", "raw_level", "level")


PATHS = f"""{LEVELED},
marks AS (
  SELECT *, {', '.join(f"max(CASE WHEN lv = {n} THEN block_no END) OVER w AS p{n}, last_value(CASE WHEN lv = {n} THEN one END IGNORE NULLS) OVER w AS h{n}" for n in range(1, 7))}
  FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)),
pathed AS (
  SELECT doc_id, block_no, CASE WHEN lv IS NOT NULL THEN 'heading' ELSE kind END AS kind, text, lv AS level,
    list_filter([h1, {', '.join('CASE WHEN ' + ' AND '.join(f'p{n} > coalesce(p{m}, 0)' for m in range(1, n)) + f' THEN h{n} END' for n in range(2, 7))}],
      lambda h: h IS NOT NULL) AS path FROM marks)"""


def sectioned(t: Tables) -> DataFrame:
    return bl.section_paths(bl.detect_headings(markdown_blocks(t)))


@query(
    "section_path",
    f"WITH {PATHS} SELECT doc_id, block_no, kind, level, array_to_string(path, ' > ') AS section FROM pathed",
)
def section_path(t: Tables) -> DataFrame:
    return sectioned(t).select(
        "doc_id", "block_no", "kind", "level", F.array_join("section_path", " > ").alias("section")
    )


RUNS = f"""{PATHS},
labelled AS (SELECT *, array_to_string(path, ' > ') AS section FROM pathed),
fresh AS (
  SELECT *, CASE WHEN lag(section) OVER w IS DISTINCT FROM section OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f
  FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
runs AS (SELECT *, (sum(f) OVER (PARTITION BY doc_id ORDER BY block_no))::BIGINT AS run_no FROM fresh)"""


@query(
    "section_runs",
    f"WITH {RUNS} SELECT doc_id, run_no, any_value(section) AS section, count(*) AS n_blocks, min(block_no) AS first_block "
    "FROM runs GROUP BY 1, 2",
)
def section_runs(t: Tables) -> DataFrame:
    page = Window.partitionBy("doc_id").orderBy("block_no")
    labelled = sectioned(t).withColumn("section", F.array_join("section_path", " > "))
    fresh = (~F.lag("section").over(page).eqNullSafe(F.col("section"))).cast("int")
    runs = labelled.withColumn("f", fresh).withColumn("run_no", F.sum("f").over(page))
    return runs.groupBy("doc_id", "run_no").agg(
        F.first("section").alias("section"), F.count(F.lit(1)).alias("n_blocks"), F.min("block_no").alias("first_block")
    )


GROUPS = f"""{RUNS},
opened AS (
  SELECT *, kind = 'table' AS atomic,
    CASE WHEN kind = 'table' OR coalesce(lag(kind) OVER w = 'table', true) OR lag(run_no) OVER w IS DISTINCT FROM run_no
      THEN 1 ELSE 0 END AS o
  FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
numbered AS (SELECT *, (sum(o) OVER (PARTITION BY doc_id ORDER BY block_no))::BIGINT AS group_no FROM opened),
groups AS (
  SELECT doc_id, run_no, group_no, any_value(section) AS section, any_value(path) AS path, bool_or(atomic) AS atomic,
    string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM numbered GROUP BY 1, 2, 3)"""


@query("prose_runs", f"WITH {GROUPS} SELECT doc_id, run_no, group_no, section, atomic, text FROM groups")
def prose_runs(t: Tables) -> DataFrame:
    runs = ch.text_runs(sectioned(t), 100_000)
    return runs.select("doc_id", "run_no", "group_no", "section", "atomic", "text")


@query(
    "chunk_numbering",
    f"""WITH {GROUPS}, numbered2 AS (
  SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY group_no) - 1 AS chunk_index, text FROM groups)
SELECT doc_id, section, chunk_index, doc_id || '::p1::c' || chunk_index AS chunk_id, length(text) AS n_chars FROM numbered2""",
)
def chunk_numbering(t: Tables) -> DataFrame:
    runs = ch.text_runs(sectioned(t), 100_000)
    none = F.lit(None).cast("string")
    drafts = runs.withColumns({"piece_no": F.lit(0), "embed_text": none, "parent_key": none})
    return ch.number_chunks(drafts).select(
        "doc_id", "section", "chunk_index", "chunk_id", F.length("text").alias("n_chars")
    )


@query(
    "section_header_prefix",
    f"""WITH {GROUPS} SELECT doc_id, group_no, CASE WHEN len(path) = 0 THEN ''
  WHEN length('[' || section || ']') + 2 <= 200 * 0.25 THEN '[' || section || ']' || chr(10) || chr(10)
  WHEN length('[' || path[-1] || ']') + 2 <= 200 * 0.25 THEN '[' || path[-1] || ']' || chr(10) || chr(10)
  ELSE '' END AS header FROM groups""",
)
def section_header_prefix(t: Tables) -> DataFrame:
    runs = ch.text_runs(sectioned(t), 100_000)
    return runs.select("doc_id", "group_no", ch.section_header(F.col("section_path"), 200).alias("header"))


FONTS = """
raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
sized AS (SELECT *, round((9.0::DOUBLE + (line_no * 7 + doc_id) % 4 * 1.02::DOUBLE) / 0.5::DOUBLE) * 0.5 AS font_size FROM raw),
weights AS (SELECT doc_id, font_size, sum(length(line)) AS w FROM sized GROUP BY 1, 2),
body AS (
  SELECT doc_id, font_size AS body_size FROM weights
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, font_size) = 1)"""


def font_lines(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    size = 9.0 + ((F.col("i") + 1) * 7 + F.col("doc_id")) % 4 * 1.02
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), "line", size.alias("font_size"))


@query("weighted_mode", f"WITH {FONTS} SELECT doc_id, body_size FROM body")
def weighted_mode(t: Tables) -> DataFrame:
    return bl.body_sizes(font_lines(t))


@query(
    "heading_levels",
    f"""WITH {FONTS},
heads AS (
  SELECT s.*, body_size FROM sized s JOIN body USING (doc_id)
  WHERE font_size >= body_size * 1.1::DOUBLE AND length(line) <= 120)
SELECT doc_id, line_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS level FROM heads""",
)
def heading_levels(t: Tables) -> DataFrame:
    lines = font_lines(t)
    rounded = F.bround(F.col("font_size") / bl.FONT_STEP) * bl.FONT_STEP
    short = lines.filter(F.length("line") <= bl.HEADING_MAX_CHARS)
    joined = short.withColumn("font_size", rounded).join(bl.body_sizes(lines), "doc_id")
    large = joined.filter(F.col("font_size") >= F.col("body_size") * bl.HEADING_SIZE_RATIO)
    blocks = large.select(
        "doc_id", F.lit(1).alias("page_no"), F.col("line_no").alias("block_no"), F.lit("text").alias("kind"),
        F.col("line").alias("text"), F.lit(None).cast("int").alias("level"), "font_size", "body_size",
    )
    return bl.detect_headings(blocks).select("doc_id", F.col("block_no").alias("line_no"), "level")


@query(
    "running_boilerplate",
    f"""WITH {PAGE_BLOCKS},
ends AS (SELECT *, max(block_no) OVER (PARTITION BY doc_id) AS last_no FROM pblocks),
lines AS (
  SELECT doc_id % 10 AS group_id, doc_id AS page_id, block_no AS line_no, text AS line, block_no <= 3 OR block_no = last_no AS margin FROM ends),
keyed AS (SELECT *, CASE WHEN margin THEN regexp_replace({sp.collapse('lower(line)')}, '[0-9]+', '#', 'g') END AS key FROM lines),
seen AS (SELECT group_id, key, count(DISTINCT page_id) AS n FROM keyed WHERE margin AND key <> '' GROUP BY 1, 2),
sizes AS (SELECT group_id, count(DISTINCT page_id) AS total FROM lines GROUP BY 1)
SELECT k.group_id, page_id, line_no, line FROM keyed k JOIN sizes USING (group_id) LEFT JOIN seen s ON s.group_id = k.group_id AND s.key = k.key
WHERE NOT (total >= 3 AND coalesce(n, 0) >= total * 0.01::DOUBLE)
  AND NOT (margin AND regexp_matches({sp.strip('line')}, '(?i)^[\\-–—\\s]*(?:page\\s+)?\\d+\\s*(?:of\\s+\\d+)?[\\-–—\\s]*$'))""",
)
def running_boilerplate(t: Tables) -> DataFrame:
    blocks = page_blocks(t)
    last = F.max("block_no").over(Window.partitionBy("doc_id"))
    lines = blocks.select(
        (F.col("doc_id") % 10).alias("group_id"), F.col("doc_id").alias("page_id"), F.col("block_no").alias("line_no"),
        F.col("text").alias("line"), ((F.col("block_no") <= 3) | (F.col("block_no") == last)).alias("margin"),
    )
    kept = bl.without_boilerplate(lines, share=0.01)
    return kept.select("group_id", "page_id", "line_no", "line")


# Chunking ---------------------------------------------------------------------

HORIZONTAL = tx.HORIZONTAL
NORM = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), "
    f"'{HORIZONTAL}+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), "
    f"'^{sp.SPACE}+|{sp.SPACE}+$', '', 'g')"
).replace("{{", "{").replace("}}", "}")


@query("normalize_text", f"SELECT doc_id, {NORM} AS text FROM documents")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query("split_sentences")
def split_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence"))


STEP = 400
LINE_LEVELS = ("line", "character")
PIECES = f"""
norm AS (SELECT doc_id, {NORM} AS text FROM documents),
big AS (SELECT * FROM norm WHERE length(text) > {STEP}),
lined AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i,
         len(string_split(text, chr(10))) AS n FROM big),
kept AS (SELECT doc_id, i, l || CASE WHEN i < n THEN chr(10) ELSE '' END AS p FROM lined),
cut AS (
  SELECT doc_id, i, o, substr(p, o + 1, {STEP}) AS p FROM (
    SELECT doc_id, i, p, unnest(range(0, greatest(length(p), 1), {STEP})) AS o FROM kept)
  UNION ALL SELECT doc_id, 1, 0, text FROM norm WHERE length(text) <= {STEP}),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, o) AS k, p FROM cut WHERE p <> '')"""


@query("separator_cascade", f"WITH {PIECES} SELECT doc_id, k AS piece_no, p AS piece FROM pieces")
def separator_cascade(t: Tables) -> DataFrame:
    pieces = ch.split_pieces(tx.normalize(F.col("text")), STEP, levels=LINE_LEVELS)
    exploded = t.documents.select("doc_id", F.posexplode(pieces).alias("i", "piece"))
    return exploded.select("doc_id", (F.col("i") + 1).alias("piece_no"), "piece")


PACKED = f"""{PIECES},
walk AS (
  SELECT doc_id, k, 1 AS win, p AS cur FROM pieces WHERE k = 1
  UNION ALL
  SELECT w.doc_id, n.k, CASE WHEN length(w.cur) + length(n.p) > {STEP} THEN w.win + 1 ELSE w.win END,
         CASE WHEN length(w.cur) + length(n.p) > {STEP} THEN n.p ELSE w.cur || n.p END
  FROM walk w JOIN pieces n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
windows AS (SELECT doc_id, win, arg_max(cur, k) AS w FROM walk GROUP BY 1, 2)"""


@query("greedy_pack", f"WITH RECURSIVE {PACKED} SELECT doc_id, win AS window_no, w AS piece FROM windows")
def greedy_pack(t: Tables) -> DataFrame:
    pieces = ch.split_pieces(tx.normalize(F.col("text")), STEP, levels=LINE_LEVELS)
    packed = t.documents.select("doc_id", F.posexplode(ch.pack(pieces, STEP)).alias("i", "piece"))
    return packed.select("doc_id", (F.col("i") + 1).alias("window_no"), "piece")


@query(
    "overlap_carry",
    f"""WITH RECURSIVE {PACKED},
placed AS (
  SELECT doc_id, win, w, coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM windows),
tails AS (SELECT p.*, right(left(n.text, start::BIGINT), 80) AS tail FROM placed p JOIN norm n USING (doc_id)),
snapped AS (
  SELECT *, CASE WHEN regexp_extract(tail, '(?s)^{sp.SPACE.replace("[", "[^", 1)}*{sp.SPACE}(.+)$', 1) <> ''
    THEN regexp_extract(tail, '(?s)^{sp.SPACE.replace("[", "[^", 1)}*{sp.SPACE}(.+)$', 1) ELSE tail END AS prefix FROM tails),
chunked AS (SELECT doc_id, win, {sp.strip('prefix || w')} AS chunk FROM snapped)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY win) AS chunk_no, chunk FROM chunked WHERE chunk <> ''""",
)
def overlap_carry(t: Tables) -> DataFrame:
    chunks = ch.split_text(F.col("text"), STEP + 80, 80, levels=LINE_LEVELS)
    exploded = t.documents.select("doc_id", F.posexplode(chunks).alias("i", "chunk"))
    return exploded.select("doc_id", (F.col("i") + 1).alias("chunk_no"), "chunk")


def runs_of(t: Tables, size: int) -> DataFrame:
    return ch.text_runs(sectioned(t), size)


@query("recursive_chunks")
def recursive_chunks(t: Tables) -> DataFrame:
    return ch.chunk_with("recursive", runs_of(t, 500), 80)


@query("parent_document_chunks")
def parent_document_chunks(t: Tables) -> DataFrame:
    return ch.chunk_with("parent_document", runs_of(t, 500), 80)


@query("sentence_window_chunks")
def sentence_window_chunks(t: Tables) -> DataFrame:
    return ch.chunk_with("sentence_window", runs_of(t, 500), 80)


@query("semantic_chunks")
def semantic_chunks(t: Tables) -> DataFrame:
    return ch.chunk_with("semantic", runs_of(t, 500), 80, embed=models.hashed_embedding)


@query("propositional_chunks")
def propositional_chunks(t: Tables) -> DataFrame:
    runs = staged(runs_of(t, 500))
    reply = F.concat(
        F.lit("1. "), F.left("text", F.lit(90)), F.lit("\n- "), F.right("text", F.lit(90)), F.lit("\nshort")
    )
    replies = runs.select(
        ch.passage_id(F.col("doc_id"), F.col("page_no"), F.col("group_no"), F.lit(0)).alias("passage_id"), reply.alias("reply")
    )
    return ch.chunk_with("propositional", runs, 80, replies=replies)


@query("chunk_strategy_select")
def chunk_strategy_select(t: Tables) -> DataFrame:
    runs = staged(runs_of(t, 500))
    out = None
    for name in ("recursive", "parent_document"):
        chunks = ch.chunk_with(name, runs, 80)
        counted = chunks.groupBy(F.lit(name).alias("strategy")).agg(F.count(F.lit(1)).alias("n_chunks"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "sentence_windows",
    """WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, line AS embed_text, 'w0:' || pos // 3 AS parent_key,
  array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' ') AS text FROM raw""",
)
def sentence_windows(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    around = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-ch.WINDOW_SENTENCES, ch.WINDOW_SENTENCES)
    return lines.select(
        "doc_id", "pos", F.col("line").alias("embed_text"),
        F.concat(F.lit("w0:"), F.floor(F.col("pos") / ch.WINDOW_SENTENCES).cast("string")).alias("parent_key"),
        F.array_join(F.collect_list("line").over(around), " ").alias("text"),
    )


DISTANCES = """
seq AS (
  SELECT label, vec_id // 50 AS part, vec_id, embedding::DOUBLE[] AS e,
         lag(embedding::DOUBLE[]) OVER (PARTITION BY label, vec_id // 50 ORDER BY vec_id) AS before FROM embeddings),
dist AS (SELECT label, part, vec_id, 1 - list_inner_product(e, before) AS d FROM seq),
limits AS (SELECT label, part, quantile_cont(d, 0.95) AS threshold, count(*) AS n FROM dist GROUP BY 1, 2)"""


def vector_steps(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.floor(F.col("vec_id") / 50).alias("part"), F.col("vec_id").alias("sent_no"), "embedding")
    order = Window.partitionBy("label", "part").orderBy("sent_no")
    before = rows.withColumn("before", F.lag("embedding").over(order))
    dot = F.aggregate(
        F.zip_with("embedding", "before", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    measured = before.withColumn("distance", 1.0 - dot).drop("embedding", "before")
    return ch.semantic_groups(measured, ("label", "part"))


@query("semantic_threshold", f"WITH {DISTANCES} SELECT label, part, round(threshold, 6) AS threshold FROM limits")
def semantic_threshold(t: Tables) -> DataFrame:
    return vector_steps(t).groupBy("label", "part").agg(F.round(F.max("threshold"), 6).alias("threshold"))


@query(
    "semantic_breaks",
    f"""WITH {DISTANCES}
SELECT label, part, vec_id AS sent_no, (sum(CASE WHEN d > threshold AND n >= 4 THEN 1 ELSE 0 END)
  OVER (PARTITION BY label, part ORDER BY vec_id))::BIGINT AS passage_no FROM dist JOIN limits USING (label, part)""",
)
def semantic_breaks(t: Tables) -> DataFrame:
    return vector_steps(t).select("label", "part", "sent_no", "passage_no")


@query(
    "document_synopsis",
    f"""WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, n, {sp.strip('line')} AS line FROM raw),
r AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM s WHERE line <> '')
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS synopsis FROM r WHERE so_far < 2000 GROUP BY 1""",
)
def document_synopsis(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ch.synopsis(lines)


@query(
    "context_line_prefix",
    f"""WITH replies AS (SELECT doc_id, '"' || left(text, 30 + doc_id % 150) || '"' AS reply FROM documents WHERE doc_id % 3 <> 0),
c AS (SELECT doc_id, {sp.strip("regexp_replace(" + sp.collapse('reply') + ", '^\"+|\"+$', '', 'g')")} AS line FROM replies),
f AS (SELECT *, {sp.strip("string_split(line, '. ')[1]")} AS first FROM c),
l AS (SELECT doc_id, CASE WHEN length(line) <= 100 THEN line WHEN length(first) > 100 THEN ''
   WHEN first LIKE '%.' THEN first ELSE first || '.' END AS line FROM f)
SELECT d.doc_id AS chunk_id, CASE WHEN coalesce(line, '') = '' THEN text ELSE line || chr(10) || chr(10) || text END AS text
FROM documents d LEFT JOIN l USING (doc_id)""",
)
def context_line_prefix(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("text").alias("embed_text"))
    replies = t.documents.filter("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit('"'), F.left("text", 30 + F.col("doc_id").cast("int") % 150), F.lit('"')).alias("reply"),
    )
    return ch.with_context(chunks, replies, 100).select("chunk_id", "text")


@query(
    "proposition_cleanup",
    f"""WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, {sp.strip("regexp_replace(" + sp.strip('line') + ", '^[-*•0-9.) ]+', '')")} AS p FROM raw)
SELECT doc_id AS passage_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS prop_no, p AS proposition FROM c
WHERE length(p) >= 20 AND length(p) <= 256 QUALIFY prop_no <= 20""",
)
def proposition_cleanup(t: Tables) -> DataFrame:
    return clean_propositions(t.documents.select(F.col("doc_id").alias("passage_id"), F.col("text").alias("reply")))


SUPPLIER_GROUPS = """
numbered AS (
  SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rn, s_suppkey, s_name FROM supplier),
groups AS (
  SELECT s_nationkey, rn // 20 AS group_no, '| s_suppkey | s_name |' || chr(10) || '| --- | --- |' || chr(10) ||
    string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY rn) AS text FROM numbered GROUP BY 1, 2)"""


def supplier_groups(t: Tables) -> DataFrame:
    return fi.table_row_groups(
        t.supplier, "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"], F.floor(F.col("s_suppkey") / 1000)
    )


@query("delimited_row_groups", f"WITH {SUPPLIER_GROUPS} SELECT s_nationkey, group_no, text FROM groups")
def delimited_row_groups(t: Tables) -> DataFrame:
    return supplier_groups(t)


@query(
    "table_row_split",
    f"""WITH RECURSIVE numbered AS (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand, p_partkey // 40 ORDER BY p_partkey) AS rn, p_partkey // 40 AS part,
    '| ' || p_partkey || ' | ' || p_name || ' |' AS line FROM part),
walk AS (
  SELECT p_brand, part, rn, 1 AS seg, line AS cur FROM numbered WHERE rn = 1
  UNION ALL
  SELECT w.p_brand, w.part, n.rn,
    CASE WHEN 45 + length(w.cur) + 1 + length(n.line) > 100 AND total > 100 THEN w.seg + 1 ELSE w.seg END,
    CASE WHEN 45 + length(w.cur) + 1 + length(n.line) > 100 AND total > 100 THEN n.line ELSE w.cur || chr(10) || n.line END
  FROM walk w JOIN numbered n ON n.p_brand = w.p_brand AND n.part = w.part AND n.rn = w.rn + 1
  JOIN (SELECT p_brand, part, 44 + sum(length(line) + 1) AS total FROM numbered GROUP BY 1, 2) t ON t.p_brand = w.p_brand AND t.part = w.part)
SELECT p_brand, part, seg - 1 AS seg_no, '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || repeat(' ', 8) || chr(10) || arg_max(cur, rn) AS text
FROM walk GROUP BY 1, 2, 3""",
)
def table_row_split(t: Tables) -> DataFrame:
    line = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_name"), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda r: r["l"])
    tables = t.part.groupBy("p_brand", F.floor(F.col("p_partkey") / 40).alias("part")).agg(
        F.array_join(F.concat(F.array(F.lit("| p_partkey | p_name |"), F.lit("| --- | --- |" + " " * 8)), rows), "\n").alias("table")
    )
    return tables.select("p_brand", "part", F.posexplode(ch.table_parts(F.col("table"), 100)).alias("seg_no", "text"))


@query(
    "upload_admission",
    """WITH files AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || '.HTML' WHEN 1 THEN 'b.' || page_id || '.exe' WHEN 2 THEN 'plain' || page_id ELSE 'c.md' END AS filename,
    CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 11 = 0 THEN 30000000 ELSE length(encode(html)) END AS n_bytes FROM pages)
SELECT page_id, filename, CASE
  WHEN page_id % 4 = 1 THEN 'Unsupported file type ''.exe''.'
  WHEN page_id % 4 = 2 THEN 'Unsupported file type ''' || filename || '''.'
  WHEN n_bytes > 26214400 THEN 'File exceeds the 25MB upload limit.' WHEN n_bytes = 0 THEN 'File is empty.' END AS reject_reason FROM files""".replace(
        "length(encode(html))", "octet_length(encode(html))"
    ),
)
def upload_admission(t: Tables) -> DataFrame:
    n = F.col("page_id")
    name = (
        F.when(n % 4 == 0, F.concat(F.lit("a"), n.cast("string"), F.lit(".HTML")))
        .when(n % 4 == 1, F.concat(F.lit("b."), n.cast("string"), F.lit(".exe")))
        .when(n % 4 == 2, F.concat(F.lit("plain"), n.cast("string")))
        .otherwise("c.md")
    )
    size = F.when(n % 7 == 0, 0).when(n % 11 == 0, 30_000_000).otherwise(F.octet_length("html"))
    return fi.admit(t.pages.select("page_id", name.alias("filename"), size.alias("n_bytes"))).drop("n_bytes")


@query(
    "decode_fallback",
    "SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 OR regexp_matches(text, '^[\\x00-\\x7f\\x{a0}-\\x{ff}]*$')",
)
def decode_fallback(t: Tables) -> DataFrame:
    narrow = F.col("text").rlike("^[\\x00-\\x7f\\xa0-\\xff]*$")
    kept = t.documents.filter((F.col("doc_id") % 2 == 0) | narrow)
    content = F.when(F.col("doc_id") % 4 == 0, F.encode(F.concat(F.lit("﻿"), "text"), "UTF-8")).when(
        F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")
    ).otherwise(F.encode(F.when(narrow, F.col("text")).otherwise(""), "ISO-8859-1"))
    return kept.select("doc_id", fi.decode_bytes(content).alias("text"))


SPARSE = f"""
lens AS (SELECT doc_id % 40 AS document_id, doc_id AS page_no, length(regexp_replace(text, '{sp.SPACE}+', '', 'g')) AS n FROM documents)"""


@query(
    "sparse_page_selection",
    f"WITH {SPARSE} SELECT document_id, page_no FROM lens WHERE n < 400 "
    "QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page_no) <= 3",
)
def sparse_page_selection(t: Tables) -> DataFrame:
    solid = F.length(F.regexp_replace("text", f"{tx.SPACE}+", ""))
    sparse = t.documents.filter(solid < 400).select((F.col("doc_id") % 40).alias("document_id"), F.col("doc_id").alias("page_no"))
    order = Window.partitionBy("document_id").orderBy("page_no")
    return sparse.withColumn("n", F.row_number().over(order)).filter("n <= 3").drop("n")


@query(
    "no_text_reason",
    f"""WITH {SPARSE} SELECT document_id, CASE WHEN bool_or(page_no % 5 = 0) THEN 'ocr found nothing readable'
  WHEN document_id % 2 = 0 THEN 'ocr unavailable' ELSE 'no words' END AS reason,
  bool_or(page_no % 5 = 0) AND count(*) > 20 AS capped FROM lens GROUP BY document_id""",
)
def no_text_reason(t: Tables) -> DataFrame:
    rows = t.documents.select((F.col("doc_id") % 40).alias("document_id"), (F.col("doc_id") % 5 == 0).alias("from_ocr"))
    per_doc = rows.groupBy("document_id").agg(F.bool_or("from_ocr").alias("ocr"), F.count(F.lit(1)).alias("n"))
    return per_doc.select(
        "document_id",
        F.when(F.col("ocr"), "ocr found nothing readable")
        .when(F.col("document_id") % 2 == 0, "ocr unavailable")
        .otherwise("no words")
        .alias("reason"),
        (F.col("ocr") & (F.col("n") > 20)).alias("capped"),
    )


@query(
    "oversized_text_report",
    f"""WITH n AS (SELECT len(list_filter(regexp_split_to_array(text, '{sp.SPACE}+'), lambda w: w <> '')) AS n FROM documents)
SELECT count(*) AS n_texts, count(*) FILTER (n > 256) AS n_oversized, max(n) AS longest FROM n""",
)
def oversized_text_report(t: Tables) -> DataFrame:
    words = t.documents.select(models.WORDS.count(F.col("text")).alias("n"))
    return words.agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("n") > 256).alias("n_oversized"), F.max("n").alias("longest")
    )
