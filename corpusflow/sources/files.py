"""Reading uploaded files: admission, decoding, delimited text.

Files arrive as rows of ``binaryFile`` (or any table with a name and bytes).
The admission cap bounds one file, so one file per row is bounded as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.scalars import UPLOAD_EXTENSIONS, extension, pipe_table
from corpusflow.operators.ordered import ranked

# Fixed values ---------------------------------------------------------------
MAX_UPLOAD_MB = 25
ROWS_PER_GROUP = 20
SNIFF_CHARS = 4096
DELIMITERS = (",", ";", "\t", "|")
# Code points of the bytes 0x80-0x9F in Windows-1252; five bytes are undefined.
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
CP1252_HIGH = bytes(b for b in range(0x80, 0xA0) if chr(b) not in CP1252_UNDEFINED)
# End of fixed values --------------------------------------------------------


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, content, n_bytes`` of every file below ``folder``.

    Spark's file readers pass over files of zero bytes; those come from the
    listing that every reader makes, as rows with empty content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("filename")
    listed = spark.createDataFrame([(path,) for path in files.inputFiles()], "path string")
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^([a-z]+):/+", "$1:/").alias("path")
    read = files.select(F.regexp_replace("path", "^([a-z]+):/+", "$1:/").alias("path"))
    empty = listed.select(plain).join(read, "path", "left_anti")
    return files.select(name, "content", F.col("length").alias("n_bytes")).unionByName(
        empty.select(name, F.lit(b"").alias("content"), F.lit(0).cast("bigint").alias("n_bytes"))
    )


def reject_reason(filename: Column, n_bytes: Column, max_mb: int = MAX_UPLOAD_MB) -> Column:
    """NULL for an accepted upload, else the first rule it breaks."""
    suffix = extension(filename)
    return (
        F.when(
            ~suffix.isin(*UPLOAD_EXTENSIONS),
            F.concat(
                F.lit("Unsupported file type '"), F.when(suffix != "", suffix).otherwise(filename), F.lit("'.")
            ),
        )
        .when(n_bytes > max_mb * 1024 * 1024, f"File exceeds the {max_mb}MB upload limit.")
        .when(n_bytes == 0, "File is empty.")
    )


def admit(files: DataFrame, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """Add ``reject_reason``; a bad file is a row with a reason, never a failure."""
    return files.withColumn("reject_reason", reject_reason(F.col("filename"), F.col("n_bytes"), max_mb))


def decode_bytes(content: Column) -> Column:
    """UTF-8 (with or without BOM), else Windows-1252, else Latin-1."""
    raw = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    cp1252 = F.translate(latin, CP1252_HIGH.decode("latin-1"), CP1252_HIGH.decode("cp1252"))
    single_byte = F.when(latin.rlike(f"[{CP1252_UNDEFINED}]"), latin).otherwise(cp1252)
    return F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^﻿", "")).otherwise(single_byte)


def guess_delimiter(text: Column) -> Column:
    """The candidate that splits most of the opening lines like the first one."""
    lines = F.filter(
        F.split(F.regexp_replace(F.left(text, F.lit(SNIFF_CHARS)), '"[^"]*"', ""), "\r\n|\r|\n"),
        lambda line: tx.strip(line) != "",
    )

    def count(line: Column, mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    def like_first(mark: str):
        return lambda line: count(line, mark) == count(F.get(lines, F.lit(0)), mark)

    scores = []
    for position, mark in enumerate(DELIMITERS):
        head = count(F.get(lines, F.lit(0)), mark)
        same = F.size(F.filter(lines, like_first(mark)))
        scores.append(
            F.struct(
                F.when(head > 0, same).otherwise(0).alias("same"), head.alias("head"),
                F.lit(-position).alias("p"), F.lit(mark).alias("mark"),
            )
        )
    best = F.greatest(*scores)
    return F.when(best["same"] > 0, best["mark"]).otherwise(",")


def delimited_rows(text: Column) -> Column:
    """Rows of cells of a delimited text; quoted fields may hold line breaks."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    records = F.regexp_extract_all(unix, F.lit('(?:[^"\n]++|"[^"]*+")++'), F.lit(0))

    def cells_by(mark: str):
        literal = "\\" + mark if mark == "|" else mark
        field = f'((?:[^"{literal}]++|"[^"]*+")*+)(?:{literal}|$)'

        def cells(record: Column) -> Column:
            # A closing delimiter is added so that the last cell ends like the others.
            raw = F.regexp_extract_all(F.concat(record, F.lit(mark)), F.lit(field), F.lit(1))
            trimmed = F.slice(raw, 1, F.size(raw) - 1)
            return F.transform(
                trimmed,
                lambda c: tx.collapse(
                    F.replace(F.regexp_replace(c, '^"|"(?=$)', ""), F.lit('""'), F.lit('"'))
                ),
            )

        return cells

    by_mark = [(mark, F.transform(records, cells_by(mark))) for mark in DELIMITERS]
    chosen = guess_delimiter(text)
    rows = F.when(chosen == by_mark[0][0], by_mark[0][1])
    for mark, parsed in by_mark[1:]:
        rows = rows.when(chosen == mark, parsed)
    return F.filter(rows, lambda row: F.exists(row, lambda cell: cell != ""))


def delimited_blocks(files: DataFrame, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """``doc_id, text`` -> table blocks of up to ``rows_per_group`` rows plus header."""
    parsed = files.select("doc_id", delimited_rows(F.col("text")).alias("rows"))
    body = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    last = F.greatest(F.floor((F.size("rows") - 2) / rows_per_group), F.lit(0)).cast("int")
    groups = parsed.filter(F.size("rows") > 0).select(
        "doc_id", "rows", body.alias("body"), F.explode(F.sequence(F.lit(0), last)).alias("g")
    )
    part = F.slice("body", F.col("g") * rows_per_group + 1, F.lit(rows_per_group))
    return groups.select(
        "doc_id", F.lit(1).alias("page_no"), (F.col("g") + 1).alias("block_no"), F.lit("table").alias("kind"),
        pipe_table(F.concat(F.slice("rows", 1, 1), part)).alias("text"), F.lit(None).cast("int").alias("level"),
    )


def table_row_groups(
    rows: DataFrame, key: str, order: str, cells: list[str], bucket: Column, rows_per_group: int = ROWS_PER_GROUP
) -> DataFrame:
    """A table already in columns -> header-repeating groups per ``key``."""
    numbered = ranked(rows, [key], [F.col(order)], bucket, "rn").withColumn(
        "group_no", F.floor((F.col("rn") - 1) / rows_per_group)
    )
    row = F.struct("rn", F.array(*[tx.collapse(F.col(c).cast("string")) for c in cells]).alias("cells"))
    collected = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])
    header = F.array(F.array(*[F.lit(c) for c in cells]))
    return numbered.groupBy(key, "group_no").agg(pipe_table(F.concat(header, collected)).alias("text"))
