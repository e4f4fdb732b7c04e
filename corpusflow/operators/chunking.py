"""Cutting text into budget-bound chunks.

The text of one document is one row, so splitting, packing and overlap happen
inside that row, without a shuffle. Texts measured in characters are cut in
Python workers (``cut_text``), all others by array expressions. ``Measure`` says
how long a text is; both built-in measures never count a joined text as longer
than its parts, so a repeated tail plus fresh text always fits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import cutting
from corpusflow.functions import text as tx
from corpusflow.functions.models import CHARACTERS, Measure
from corpusflow.operators.replies import clean_propositions

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHILD_SIZE = 64
WINDOW_SENTENCES = 3
BREAK_PERCENTILE = 0.95
MIN_SENTENCES = 4
HEADER_SHARE = 0.25
SYNOPSIS_CHARS = 2000
LEVELS = ("paragraph", "line", "sentence", "word", "character")
STRATEGIES = ("recursive", "semantic", "sentence_window", "parent_document", "propositional")


def check_budget(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be a positive integer.")
    if overlap < 0:
        raise ValueError("chunk_overlap must not be negative.")
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size.")


def _strings(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def pack(pieces: Column, budget: Column | int, measure: Measure = CHARACTERS) -> Column:
    """Glue consecutive pieces together while the joined text fits."""
    empty = F.struct(_strings().alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.concat(acc["cur"], piece)
        return F.when(
            (acc["cur"] != "") & (measure.count(joined) > budget),
            F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), piece.alias("cur")),
        ).otherwise(F.struct(acc["done"].alias("done"), joined.alias("cur")))

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    return F.aggregate(pieces, empty, step, finish)


def _cut_blind(piece: Column, limit: Column, measure: Measure) -> Column:
    if measure is CHARACTERS:
        starts = F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / limit).cast("int"))
        return F.transform(starts, lambda i: F.substring(piece, i * limit + 1, limit))
    return pack(F.filter(F.split(piece, ""), lambda c: c != ""), limit, measure)


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def split_pieces(
    text: Column, limit: Column | int, measure: Measure = CHARACTERS, levels: tuple[str, ...] = LEVELS
) -> Column:
    """Pieces of at most ``limit``; joined they give the text back."""
    limit = _column(limit)
    cutters = {
        "paragraph": lambda p: tx.split_keep(p, "\n\n"),
        "line": lambda p: tx.split_keep(p, "\n"),
        "sentence": tx.sentences,
        "word": lambda p: tx.split_keep(p, " "),
        "character": lambda p: _cut_blind(p, limit, measure),
    }

    def refine(cutter):
        return lambda p: F.when(measure.count(p) <= limit, F.array(p)).otherwise(cutter(p))

    pieces = F.array(text)
    for level in levels:
        pieces = F.flatten(F.transform(pieces, refine(cutters[level])))
    return F.filter(pieces, lambda p: p != "")


def snap(tail: Column) -> Column:
    """Drop the broken word at the start of a repeated tail, if one is there."""
    return F.regexp_replace(tail, f"(?s)^{tx.SPACE.replace('[', '[^', 1)}*{tx.SPACE}(?=.)", "")


def with_overlap(windows: Column, overlap: Column | int, measure: Measure = CHARACTERS) -> Column:
    """Each window with the tail of everything before it repeated in front."""
    if isinstance(overlap, int) and overlap == 0:
        return F.filter(F.transform(windows, tx.strip), lambda c: c != "")
    start = F.struct(F.lit("").alias("carry"), _strings().alias("out"))

    def step(acc: Column, window: Column) -> Column:
        return F.struct(
            measure.suffix(F.concat(acc["carry"], window), _column(overlap)).alias("carry"),
            F.concat(acc["out"], F.array(tx.strip(F.concat(snap(acc["carry"]), window)))).alias("out"),
        )

    return F.filter(F.aggregate(windows, start, step, lambda acc: acc["out"]), lambda c: c != "")


def split_text(
    text: Column,
    size: Column | int = CHUNK_SIZE,
    overlap: Column | int = CHUNK_OVERLAP,
    measure: Measure = CHARACTERS,
    levels: tuple[str, ...] = LEVELS,
) -> Column:
    """Overlapping chunks of at most ``size``, cut where a reader would cut."""
    if isinstance(size, int) and isinstance(overlap, int):
        check_budget(size, overlap)
    step = size - overlap
    pieces = split_pieces(tx.normalize(text), step, measure, levels)
    return with_overlap(pack(pieces, step, measure), overlap, measure)


def _string_array(items: list[str]) -> pa.Array:
    return pa.array(items, pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _cut_characters(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    rows = zip(cutting.strings(texts), sizes.to_pylist(), overlaps.to_pylist())
    return cutting.lists((None if text is None else cutting.chunks(text, n, k) for text, n, k in rows), _string_array)


def cut_text(
    text: Column, size: Column | int = CHUNK_SIZE, overlap: Column | int = CHUNK_OVERLAP, measure: Measure = CHARACTERS
) -> Column:
    """``split_text`` at all levels, for texts that are columns: inside a lambda function there is only ``split_text``."""
    if measure is not CHARACTERS:
        return split_text(text, size, overlap, measure)
    if isinstance(size, int) and isinstance(overlap, int):
        check_budget(size, overlap)
    return _cut_characters(text, _column(size).cast("int"), _column(overlap).cast("int"))


def is_divider(line: Column) -> Column:
    return tx.strip(line).rlike("^[|\\-: ]+$")


def table_parts(table: Column, size: Column | int, measure: Measure = CHARACTERS) -> Column:
    """An oversized pipe table cut between rows, the header on every part."""
    lines = F.split(table, "\n")
    header_rows = F.when((F.size(lines) > 1) & is_divider(F.get(lines, F.lit(1))), 2).otherwise(1)
    preamble = F.array_join(F.slice(lines, 1, header_rows), "\n")
    rows = F.slice(lines, header_rows + 1, F.greatest(F.size(lines) - header_rows, F.lit(0)))
    empty = F.struct(_strings().alias("done"), F.lit(None).cast("string").alias("cur"))

    def part(cur: Column) -> Column:
        return F.concat(preamble, F.lit("\n"), cur)

    def step(acc: Column, row: Column) -> Column:
        grown = F.concat(acc["cur"], F.lit("\n"), row)
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), row.alias("cur")))
            .when(
                measure.count(part(grown)) > size,
                F.struct(F.concat(acc["done"], F.array(part(acc["cur"]))).alias("done"), row.alias("cur")),
            )
            .otherwise(F.struct(acc["done"].alias("done"), grown.alias("cur")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"].isNotNull(), F.concat(acc["done"], F.array(part(acc["cur"])))).otherwise(
            acc["done"]
        )

    return F.when((measure.count(table) <= size) | (F.size(rows) == 0), F.array(table)).otherwise(
        F.aggregate(rows, empty, step, finish)
    )


# Blocks -> runs of text ------------------------------------------------------


def text_runs(
    blocks: DataFrame, size: int, measure: Measure = CHARACTERS, headers: bool = False
) -> DataFrame:
    """``doc_id, page_no, run_no, group_no, section, section_path, header, body, atomic, text``.

    Blocks (``doc_id, page_no, block_no, kind, text, section_path``) are cut
    into section runs, tables into row parts, and neighbouring prose is joined.
    With ``headers`` a section header is reserved out of ``size``; ``body`` is
    what is left for text. All windows share one key, so the blocks are
    shuffled once.
    """
    if size <= 0:
        raise ValueError("chunk_size must be a positive integer.")
    header = section_header(F.col("section_path"), size, measure) if headers else F.lit("")
    blocks = blocks.withColumn("header", header).withColumn("body", F.lit(size) - measure.count(F.col("header")))
    body = F.col("body")
    page = Window.partitionBy("doc_id", "page_no").orderBy("block_no")
    label = F.array_join("section_path", " > ")
    runs = (
        blocks.withColumn("section", label)
        .withColumn("_new", (~F.lag("section").over(page).eqNullSafe(F.col("section"))).cast("int"))
        .withColumn("run_no", F.sum("_new").over(page))
    )
    fence = F.ltrim(F.col("text")).rlike("^(```|~~~)") & (measure.count(F.col("text")) <= body)
    segments = runs.withColumn("atomic", (F.col("kind") == "table") | fence).select(
        "doc_id", "page_no", "block_no", "run_no", "section", "section_path", "header", "body", "atomic",
        F.posexplode(
            F.when(F.col("kind") == "table", table_parts(F.col("text"), body, measure)).otherwise(F.array("text"))
        ).alias("seg_no", "segment"),
    )
    ordered = Window.partitionBy("doc_id", "page_no").orderBy("block_no", "seg_no")
    opens = (
        F.col("atomic")
        | F.coalesce(F.lag("atomic").over(ordered), F.lit(True))
        | ~F.lag("run_no").over(ordered).eqNullSafe(F.col("run_no"))
    )
    grouped = segments.withColumn("_new", opens.cast("int")).withColumn(
        "group_no", F.sum("_new").over(ordered)
    )
    pieces = F.array_sort(F.collect_list(F.struct("block_no", "seg_no", "segment")))
    return grouped.groupBy("doc_id", "page_no", "run_no", "group_no").agg(
        F.first("section").alias("section"),
        F.first("section_path").alias("section_path"),
        F.first("header").alias("header"),
        F.first("body").alias("body"),
        F.max("atomic").alias("atomic"),
        F.array_join(F.transform(pieces, lambda s: s["segment"]), "\n\n").alias("text"),
    )


def plain_runs(texts: DataFrame, size: int, measure: Measure = CHARACTERS) -> DataFrame:
    """``doc_id, text`` of documents that are nothing but paragraphs -> the one run that ``text_runs`` makes of each."""
    if size <= 0:
        raise ValueError("chunk_size must be a positive integer.")
    first = F.lit(1).cast("bigint")
    return texts.filter("text <> ''").select(
        "doc_id", F.lit(1).alias("page_no"), first.alias("run_no"), first.alias("group_no"), F.lit("").alias("section"),
        _strings().alias("section_path"), F.lit("").alias("header"),
        (F.lit(size) - measure.count(F.lit(""))).alias("body"), F.lit(False).alias("atomic"), "text",
    )


def _draft(text: Column, embed: Column, key: Column) -> Column:
    return F.struct(text.alias("text"), embed.alias("embed_text"), key.cast("string").alias("parent_key"))


def _none() -> Column:
    return F.lit(None).cast("string")


def number_chunks(drafts: DataFrame, one_run: bool = False) -> DataFrame:
    """Chunk ids, page-wise chunk numbers and namespaced parent ids.

    Input: one row per draft with ``doc_id, page_no, group_no, piece_no,
    section, header, text, embed_text, parent_key``; the header goes in front
    of both texts. With ``one_run`` no page holds a second group, and
    ``piece_no`` counts from 0 without gaps: it is the number.
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy("group_no", "piece_no")
    number = F.col("piece_no") if one_run else F.row_number().over(page) - 1
    base = F.concat(F.col("doc_id").cast("string"), F.lit("::p"), F.col("page_no").cast("string"))
    return drafts.withColumn("chunk_index", number).select(
        "doc_id", "page_no", "chunk_index", "section",
        F.concat("header", "text").alias("text"),
        F.concat("header", F.coalesce("embed_text", "text")).alias("embed_text"),
        F.concat(base, F.lit("::c"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.when(
            F.col("parent_key").isNotNull(),
            F.concat(base, F.lit("::s"), F.col("section"), F.lit("::"), F.col("parent_key")),
        ).otherwise("").alias("parent_id"),
    )


def _finish(runs: DataFrame, drafts: Column, one_run: bool = False) -> DataFrame:
    exploded = runs.select(
        "doc_id", "page_no", "group_no", "section", "header", F.posexplode(drafts).alias("piece_no", "draft")
    )
    flat = exploded.select("doc_id", "page_no", "group_no", "piece_no", "section", "header", "draft.*")
    return number_chunks(flat, one_run)


def _alone() -> Column:
    """A table or code block is one chunk of its own."""
    return F.array(_draft(F.col("text"), _none(), _none()))


def budget(overlap: int) -> tuple[Column, Column]:
    """Chunk size and overlap of a run: what its header leaves."""
    return F.col("body"), F.least(F.lit(overlap), F.col("body") - 1)


# Strategies ------------------------------------------------------------------


def recursive_chunks(runs: DataFrame, overlap: int, measure: Measure = CHARACTERS, one_run: bool = False) -> DataFrame:
    prose = F.when(~F.col("atomic"), F.col("text"))
    cut = F.transform(cut_text(prose, *budget(overlap), measure), lambda c: _draft(c, _none(), _none()))
    return _finish(runs, F.when(F.col("atomic"), _alone()).otherwise(cut), one_run)


def parent_document_chunks(
    runs: DataFrame, overlap: int, measure: Measure = CHARACTERS, child: int = CHILD_SIZE
) -> DataFrame:
    """Small children are embedded, the parent they came from is returned."""
    prose = F.when(~F.col("atomic"), F.col("text"))
    parents = F.when(F.col("atomic"), F.array("text")).otherwise(cut_text(prose, *budget(overlap), measure))
    exploded = runs.select("*", F.posexplode(parents).alias("parent_pos", "parent"))
    # Parents are counted through the whole section run.
    order = Window.partitionBy("doc_id", "page_no", "run_no").orderBy("group_no", "parent_pos")
    keyed = exploded.withColumn("parent_no", F.row_number().over(order) - 1)
    children = cut_text(F.col("parent"), F.least(F.lit(child), F.col("body")), 0, measure)
    small = keyed.select(
        "doc_id", "page_no", "group_no", "section", "header", "parent_pos",
        F.concat(F.lit("p"), F.col("parent_no").cast("string")).alias("parent_key"),
        F.col("parent").alias("text"),
        F.posexplode(children).alias("child_no", "embed_text"),
    )
    return number_chunks(small.withColumn("piece_no", F.struct("parent_pos", "child_no")))


def grown_window(sentences: Column, position: Column, window: int, size: Column | int, measure: Measure) -> Column:
    """The neighbourhood of a sentence, widened left then right while it fits."""
    n = F.size(sentences)

    def joined(lo: Column, hi: Column) -> Column:
        return F.array_join(F.slice(sentences, lo + 1, hi - lo + 1), " ")

    def widen(acc: Column, turn: Column) -> Column:
        left = turn % 2 == 0
        lo = F.when(left, acc["lo"] - 1).otherwise(acc["lo"])
        hi = F.when(left, acc["hi"]).otherwise(acc["hi"] + 1)
        fits = (lo >= 0) & (hi < n) & (
            measure.count(joined(F.greatest(lo, F.lit(0)), F.least(hi, n - 1))) <= size
        )
        return F.when(fits, F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))
        )

    start = F.struct(position.cast("int").alias("lo"), position.cast("int").alias("hi"))
    if window <= 0:
        return F.get(sentences, position)
    turns = F.sequence(F.lit(0), F.lit(2 * window - 1))
    return F.aggregate(turns, start, widen, lambda acc: joined(acc["lo"], acc["hi"]))


def sentence_window_chunks(
    runs: DataFrame, overlap: int, measure: Measure = CHARACTERS, window: int = WINDOW_SENTENCES
) -> DataFrame:
    """Each sentence is embedded; its grown neighbourhood is returned."""
    region = max(1, window)
    stripped = F.filter(F.transform(tx.sentences(F.col("text")), tx.strip), lambda s: s != "")
    with_sentences = runs.withColumn("sentences", F.when(~F.col("atomic"), stripped)).withColumn(
        "group_in_run",
        F.dense_rank().over(Window.partitionBy("doc_id", "page_no", "run_no").orderBy("group_no")) - 1,
    )

    def draft(sentence: Column, i: Column) -> Column:
        too_long = F.get(split_text(sentence, F.col("body"), 0, measure), F.lit(0))
        text = F.when(measure.count(sentence) > F.col("body"), F.coalesce(too_long, sentence)).otherwise(
            grown_window(F.col("sentences"), i, window, F.col("body"), measure)
        )
        key = F.concat(
            F.lit("w"), F.col("group_in_run").cast("string"), F.lit(":"),
            F.floor(i / region).cast("string"),
        )
        return _draft(text, sentence, key)

    return _finish(
        with_sentences, F.when(F.col("atomic"), _alone()).otherwise(F.transform("sentences", draft))
    )


def semantic_groups(sentences: DataFrame, keys: tuple[str, ...], percentile: float = BREAK_PERCENTILE) -> DataFrame:
    """Add ``group_no`` to ordered sentences: a new group where the subject turns.

    ``sentences``: keys, ``sent_no``, ``distance`` (cosine distance to the one
    before, NULL for the first). Passages under four sentences stay whole.
    """
    order = Window.partitionBy(*keys).orderBy("sent_no")
    whole = Window.partitionBy(*keys)
    threshold = F.percentile("distance", F.lit(percentile)).over(whole)
    breaks = (F.col("distance") > F.col("threshold")) & (F.col("n") >= MIN_SENTENCES)
    return (
        sentences.withColumn("threshold", threshold)
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("is_break", F.coalesce(breaks, F.lit(False)).cast("int"))
        .withColumn("passage_no", F.sum("is_break").over(order))
        .drop("n")
    )


def semantic_chunks(
    runs: DataFrame, overlap: int, embed, measure: Measure = CHARACTERS
) -> DataFrame:
    """Sentences grouped by meaning; only oversized groups are split further.

    ``embed(df)`` adds ``embedding`` computed from ``text`` (see ``models``).
    """
    keys = ("doc_id", "page_no", "run_no", "group_no")
    prose = runs.filter(~F.col("atomic")).select(
        *keys, "section", "header", "body", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence")
    )
    prose = prose.filter(tx.strip(F.col("sentence")) != "").withColumn("text", tx.strip(F.col("sentence")))
    order = Window.partitionBy(*keys).orderBy("sent_no")
    vectors = embed(prose).withColumn("before", F.lag("embedding").over(order))
    dot = F.aggregate(
        F.zip_with("embedding", "before", lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    measured = vectors.withColumn("distance", 1.0 - dot).drop("embedding", "before", "text")
    grouped = semantic_groups(measured, keys)
    pieces = F.array_sort(F.collect_list(F.struct("sent_no", "sentence")))
    passages = grouped.groupBy(*keys, "section", "header", "body", "passage_no").agg(
        F.array_join(F.transform(pieces, lambda s: s["sentence"]), "").alias("text")
    )
    cut = passages.select(
        *keys, "section", "header", "body", "passage_no",
        F.posexplode(cut_text(F.col("text"), *budget(overlap), measure)).alias("pos", "chunk"),
    )
    drafts = cut.select(
        "doc_id", "page_no", "group_no", F.struct("passage_no", "pos").alias("piece_no"), "section", "header",
        F.col("chunk").alias("text"), _none().alias("embed_text"), _none().alias("parent_key"),
    )
    alone = runs.filter("atomic").select(
        "doc_id", "page_no", "group_no",
        F.struct(F.lit(0).cast("bigint").alias("passage_no"), F.lit(0).alias("pos")).alias("piece_no"),
        "section", "header", "text", _none().alias("embed_text"), _none().alias("parent_key"),
    )
    return number_chunks(drafts.unionByName(alone))


def passage_id(doc: Column, page: Column, group: Column, pos: Column) -> Column:
    return F.concat_ws("/", doc.cast("string"), page.cast("string"), group.cast("string"), pos.cast("string"))


def propositional_chunks(
    runs: DataFrame, overlap: int, replies: DataFrame, measure: Measure = CHARACTERS
) -> DataFrame:
    """Passages indexed by the propositions a model found in them.

    ``replies``: ``passage_id, reply``; a passage without a usable reply is
    kept whole.
    """
    prose = F.when(~F.col("atomic"), F.col("text"))
    cut = F.when(F.col("atomic"), F.array("text")).otherwise(cut_text(prose, *budget(overlap), measure))
    passages = runs.select(
        "doc_id", "page_no", "run_no", "group_no", "section", "header", "atomic", F.posexplode(cut).alias("pos", "passage")
    ).withColumn("passage_id", passage_id(F.col("doc_id"), F.col("page_no"), F.col("group_no"), F.col("pos")))
    # A passage has the budget of its group, so the replies need no second cut. Its id is the group's with its place behind.
    group = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_no").cast("string"), F.col("group_no").cast("string"))
    budgets = runs.select("doc_id", "page_no", group.alias("group_id"), "body")
    sized = replies.select("passage_id", "reply", F.regexp_replace("passage_id", "/[^/]*$", "").alias("group_id")).join(budgets, "group_id")
    found = clean_propositions(sized, F.col("body"), measure, keep=("doc_id", "page_no"))
    # Passages and propositions go to their page once, and meet there: a passage's text moves once, not with each proposition.
    own = F.struct("run_no", "group_no", "pos", "section", "header", "atomic", "passage")
    none = F.lit(None)
    moved = passages.select(
        "doc_id", "page_no", "passage_id", none.cast("int").alias("prop_no"), none.cast("string").alias("proposition"), own.alias("own")
    ).unionByName(found.withColumn("own", none.cast(passages.select(own.alias("own")).schema["own"].dataType)))
    rows = Window.partitionBy("doc_id", "page_no", "passage_id").orderBy("prop_no")
    met = (
        moved.repartition("doc_id", "page_no")
        .withColumns({"own": F.first("own").over(rows), "followed": F.lead("prop_no").over(rows).isNotNull()})
        .filter(F.col("own").isNotNull() & (F.col("prop_no").isNotNull() | ~F.col("followed")))
        .select("doc_id", "page_no", "prop_no", "proposition", "own.*")
    )
    order = Window.partitionBy("doc_id", "page_no", "run_no").orderBy("group_no", "pos")
    opens = ~F.col("atomic") & (F.coalesce("prop_no", F.lit(1)) == 1)
    keyed = met.withColumn("q", F.sum(opens.cast("int")).over(order) - 1)
    usable = F.col("proposition").isNotNull() & ~F.col("atomic")
    drafts = keyed.select(
        "doc_id", "page_no", "group_no",
        F.struct("pos", F.coalesce("prop_no", F.lit(0)).alias("prop_no")).alias("piece_no"), "section", "header",
        F.col("passage").alias("text"),
        F.when(usable, F.col("proposition")).alias("embed_text"),
        F.when(usable, F.concat(F.lit("q"), F.col("q").cast("string"))).alias("parent_key"),
    )
    return number_chunks(drafts)


def chunk_with(name: str, runs: DataFrame, overlap: int, *, embed=None, replies=None,
               measure: Measure = CHARACTERS) -> DataFrame:
    """The named strategy; an unknown or unsupported one is an error."""
    if overlap < 0:
        raise ValueError("chunk_overlap must not be negative.")
    if name not in STRATEGIES:
        raise ValueError(f"Unknown chunking strategy '{name}'. Valid options: {', '.join(STRATEGIES)}.")
    if name == "semantic":
        if embed is None:
            raise ValueError("The 'semantic' chunking strategy needs an embedding function.")
        return semantic_chunks(runs, overlap, embed, measure)
    if name == "propositional":
        if replies is None:
            raise ValueError("The 'propositional' chunking strategy needs a table of replies.")
        return propositional_chunks(runs, overlap, replies, measure)
    if name == "sentence_window":
        return sentence_window_chunks(runs, overlap, measure)
    if name == "parent_document":
        return parent_document_chunks(runs, overlap, measure)
    return recursive_chunks(runs, overlap, measure)


def chunk_all(name: str, runs: DataFrame, plain: DataFrame, overlap: int, *, measure: Measure = CHARACTERS, **inputs) -> DataFrame:
    """``chunk_with`` over ``runs`` and over those of ``plain_runs``, which need no window for their numbers."""
    if name != "recursive":
        return chunk_with(name, runs.unionByName(plain), overlap, measure=measure, **inputs)
    chunks = chunk_with(name, runs, overlap, measure=measure, **inputs)
    return chunks.unionByName(recursive_chunks(plain, overlap, measure, one_run=True))


# Headers and context ---------------------------------------------------------


def section_header(path: Column, budget: int, measure: Measure = CHARACTERS) -> Column:
    """``[A > B]`` header within a quarter of the budget, else the leaf, else ''."""
    full = F.concat(F.lit("["), F.array_join(path, " > "), F.lit("]\n\n"))
    leaf = F.concat(F.lit("["), F.element_at(path, -1), F.lit("]\n\n"))
    allowance = budget * HEADER_SHARE
    chosen = F.when(measure.count(full) <= allowance, full).when(measure.count(leaf) <= allowance, leaf)
    return F.when(F.size(path) > 0, F.coalesce(chosen, F.lit(""))).otherwise("")


def synopsis(lines: DataFrame, limit: int = SYNOPSIS_CHARS) -> DataFrame:
    """Opening lines of a document until ``limit`` characters are collected.

    ``lines``: ``doc_id, line_no, line``. The crossing line is included.
    """
    stripped = lines.withColumn("line", tx.strip(F.col("line"))).filter("line <> ''")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = stripped.withColumn("so_far", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0))).filter(
        F.col("so_far") < limit
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("synopsis")
    )


def context_line(reply: Column, reserved: int, measure: Measure = CHARACTERS) -> Column:
    """A context reply fit for a chunk: whole, its first sentence, or ''."""
    line = tx.strip(F.regexp_replace(tx.collapse(F.coalesce(reply, F.lit(""))), '^"+|"+$', ""))
    first = tx.strip(F.get(F.split(line, r"\. "), F.lit(0)))
    shortened = F.when(measure.count(first) > reserved, "").when(first.endswith("."), first).otherwise(
        F.concat(first, F.lit("."))
    )
    return F.when(measure.count(line) > reserved, shortened).otherwise(line)


def with_context(chunks: DataFrame, replies: DataFrame, reserved: int, measure: Measure = CHARACTERS) -> DataFrame:
    """Prefix the context line to the returned and the embedded text."""
    line = context_line(F.col("reply"), reserved, measure)
    joined = chunks.join(replies.select("chunk_id", "reply"), "chunk_id", "left").withColumn("line", line)

    def prefixed(text: Column) -> Column:
        return F.when(F.col("line") == "", text).otherwise(F.concat(F.col("line"), F.lit("\n\n"), text))

    return joined.withColumns(
        {"text": prefixed(F.col("text")), "embed_text": prefixed(F.col("embed_text"))}
    ).drop("reply", "line")
