"""Scalar rules: answer grading, dates, titles, type maps, table rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions import text as tx

# Fixed values ---------------------------------------------------------------
TITLE_KEYS = ("title", "og:title", "dc.title")
AUTHOR_KEYS = ("author", "authors", "creator", "dc.creator", "article:author")
SUBJECT_KEYS = ("subject", "description", "og:description", "summary")
DATE_KEYS = ("date", "created", "published", "article:published_time", "dc.date")
FILENAME_TITLE_PREFIXES = ("microsoft word - ", "microsoft powerpoint - ", "untitled")
FILENAME_TITLE_SUFFIXES = (".doc", ".docx", ".pdf", ".rtf", ".odt", ".tex", ".pages")
# Written-date formats after ISO, in the order they are tried.
DATE_FORMATS = ("d/M/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy/M/d")

ATTACHMENT_EXTENSIONS = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/webp": ".webp",
    "image/gif": ".gif",
    "audio/mpeg": ".mp3",
    "audio/mp3": ".mp3",
    "audio/wav": ".wav",
    "audio/x-wav": ".wav",
    "audio/wave": ".wav",
    "audio/m4a": ".m4a",
    "audio/x-m4a": ".m4a",
    "audio/mp4": ".m4a",
    "audio/webm": ".webm",
}
CANONICAL_MIME = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".m4a": "audio/mp4",
    ".webm": "audio/webm",
}
FRAME_MIME_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
AUDIO_EXTENSIONS = (".mp3", ".wav", ".m4a", ".webm")
AUDIO_MIME_TYPES = tuple(m for m in ATTACHMENT_EXTENSIONS if m.startswith("audio/"))
UPLOAD_EXTENSIONS = (
    ".pdf", ".docx", ".html", ".htm", ".md", ".markdown", ".txt", ".csv", ".tsv"
)
REF_PATTERN = "^[0-9a-f]{64}\\.[a-z0-9]{2,5}$"
# End of fixed values --------------------------------------------------------


def sigmoid(logit: Column) -> Column:
    """Logistic function, split by sign so neither branch overflows."""
    grown = F.exp(logit)
    return F.when(logit >= 0, 1.0 / (1.0 + F.exp(-logit))).otherwise(grown / (1.0 + grown))


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return literal_map(mapping)[key]


def extension(filename: Column) -> Column:
    """Lower-cased suffix of a file name with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]*[^./])$", 1))


def iso_date(value: Column) -> Column:
    """ISO date of a written date, or NULL; keeps the written day of a datetime."""
    text = tx.none_if_blank(value)
    head = F.regexp_extract(
        text,
        r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?"
        r"(?:Z|[+-]\d{2}:?\d{2})?)?$",
        1,
    )
    iso = F.try_to_date(F.nullif(head, F.lit("")), "yyyy-MM-dd")
    written = [F.try_to_date(text, pattern) for pattern in DATE_FORMATS]
    return F.date_format(F.coalesce(iso, *written), "yyyy-MM-dd")


def first_key(fields: Column, keys: tuple[str, ...]) -> Column:
    """Value of the first preferred key that is present and not blank."""
    return F.coalesce(*[tx.none_if_blank(fields[key]) for key in keys])


def looks_like_filename(title: Column) -> Column:
    lowered = F.lower(tx.strip(title))
    tests = [lowered.startswith(p) for p in FILENAME_TITLE_PREFIXES]
    tests += [lowered.endswith(s) for s in FILENAME_TITLE_SUFFIXES]
    hit = tests[0]
    for test in tests[1:]:
        hit = hit | test
    return hit


def stem(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*[^.]$", "")


def resolve_title(embedded: Column, first_heading: Column, filename: Column) -> Column:
    """Embedded title unless it is really a file name, else heading, else stem."""
    usable = F.when(
        (F.coalesce(embedded, F.lit("")) != "") & ~looks_like_filename(embedded), embedded
    )
    return F.coalesce(
        usable,
        F.nullif(first_heading, F.lit("")),
        F.nullif(stem(filename), F.lit("")),
        F.nullif(embedded, F.lit("")),
        F.lit("Untitled"),
    )


def states_value(answer: Column, expected: Column) -> Column:
    """Does the answer state the expected value, whatever its formatting?"""
    target = tx.digits(expected)
    numeric = F.exists(tx.values_in(answer), lambda token: tx.digits(token) == target)
    return F.when(target == "", F.contains(F.lower(answer), F.lower(expected))).otherwise(numeric)


def is_refusal(answer: Column) -> Column:
    """A hedge is present and no number of two or more digits is claimed."""
    hedged = answer.rlike(f"(?i){tx.REFUSAL_PATTERN}")
    claims = F.exists(tx.values_in(answer), lambda token: F.length(tx.digits(token)) >= 2)
    return hedged & ~claims


def unverified_values(answer: Column, source: Column) -> Column:
    """Numbers in the answer that no number of the source confirms."""
    recognised = F.transform(
        tx.values_in(F.coalesce(source, F.lit("")), tx.CURRENCY_VALUE_PATTERN), tx.digits
    )
    cleaned = F.regexp_replace(answer, tx.CITATION_PATTERN, " ")
    claimed = F.array_distinct(tx.values_in(cleaned, tx.CURRENCY_VALUE_PATTERN))
    return F.filter(
        claimed,
        lambda token: (F.length(tx.digits(token)) >= 2)
        & ~F.exists(recognised, lambda seen: seen.startswith(tx.digits(token))),
    )


def pipe_table(rows: Column) -> Column:
    """Rows of cells as a pipe table; the first row is the header."""
    width = F.array_max(F.transform(rows, F.size))

    def line(cells: Column) -> Column:
        padded = F.concat(
            F.transform(cells, lambda c: F.replace(tx.strip(c), F.lit("|"), F.lit("\\|"))),
            F.array_repeat(F.lit(""), width - F.size(cells)),
        )
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    divider = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    lines = F.concat(F.array(line(rows[0])), F.array(divider), body)
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def rewrite_or_original(reply: Column, question: Column, limit: int = 400) -> Column:
    """First usable line of a rewrite reply, or the question itself."""
    lines = F.transform(
        F.split(F.coalesce(reply, F.lit("")), "\r\n|\r|\n"),
        lambda line: tx.strip(
            F.regexp_replace(F.regexp_replace(tx.strip(line), '^"+|"+$', ""), "^'+|'+$", "")
        ),
    )
    usable = F.filter(lines, lambda line: (line != "") & ~line.endswith(":"))
    first = F.get(usable, F.lit(0))
    return F.when(F.length(first) <= limit, first).otherwise(question)
