"""Text helpers as Column expressions; every one stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# Terms the lexical index leaves out.
STOP_WORDS = (
    "a an and are as at be but by for from has have how i if in into is it its "
    "of on or that the their there these they this to was were what when where "
    "which who why will with you your"
).split()

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof rev hon st sr jr "
    "e.g i.e etc vs cf al ca approx viz fig eq ref no nos vol ch sec pp p "
    "inc ltd co corp dept est univ "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue tues wed thu thurs fri sat sun"
).split()

# Phrases of an answer that declines.
REFUSAL_PATTERN = (
    r"no\s+\w*\s*(text|content|writing|information|data|receipt|total|figures)"
    r"|(does\s?not|doesn't|is\s?not|isn't|cannot|can't|could\s?not|couldn't)"
    r"\s+(contain|show|say|include|read|appear|a\s)"
    r"|(unable|not\s+able)\s+to"
    r"|(un|not\s+)?(readable|legible)"
    r"|blank|empty"
    r"|nothing\s+(at\s+all|to\s+read|visible|here)"
    r"|photograph|photo\b|illustration|abstract"
)

VALUE_PATTERN = r"\d+(?:[.,:/\-]\d+)*"
CURRENCY_VALUE_PATTERN = r"[£$€]?\d+(?:[.,:/\-]\d+)*"
CITATION_PATTERN = r"\[E\d+\]"
# End of fixed values --------------------------------------------------------

# Unicode white space written out, because Java, RE2 and Python disagree on \s.
SPACE_CHARS = (
    " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_CHARS}]"
HORIZONTAL = SPACE.replace("\n", "")
# Every character of the class, for functions that take no pattern.
EACH_SPACE = SPACE_CHARS.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))


def strip(text: Column) -> Column:
    """Remove white space at both ends; a pattern would be tried at every character between them."""
    return F.btrim(text, F.lit(EACH_SPACE))


def rstrip(text: Column) -> Column:
    """Remove white space at the end."""
    return F.rtrim(text, F.lit(EACH_SPACE))


def collapse(text: Column) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def fold(text: Column) -> Column:
    """Lower-cased, space-collapsed comparison key."""
    return collapse(F.lower(text))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def none_if_blank(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Index terms: lower-cased runs of ``[a-z0-9]`` without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(STOP_WORDS))


def words(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9]``, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize(text: Column) -> Column:
    """Tidy extracted text while keeping line and paragraph boundaries."""
    # Most texts need few of these patterns, and seeking a literal costs little.
    out = _replaced_if(lambda t: _holds(t, "\r"), text, "\r\n?", "\n")
    out = _replaced_if(lambda t: _holds(t, "  ") | t.rlike(f"(?![ -~\n]){HORIZONTAL}"), out, f"{HORIZONTAL}+", " ")
    out = _replaced_if(lambda t: _holds(t, " \n") | _holds(t, "\n "), out, " *\n *", "\n")
    out = _replaced_if(lambda t: _holds(t, "\n\n\n"), out, "\n{3,}", "\n\n")
    return strip(out)


def _holds(text: Column, literal: str) -> Column:
    return F.contains(text, F.lit(literal))


def _replaced_if(wanted: Callable[[Column], Column], text: Column, pattern: str, by: str) -> Column:
    """``text`` with ``pattern`` replaced where ``wanted``. The array of one names the text, which is read several times."""
    return F.transform(F.array(text), lambda t: F.when(wanted(t), F.regexp_replace(t, pattern, by)).otherwise(t))[0]


_WORD = "[A-Za-z0-9.’']"
_NOT_ABBREVIATION = "(?<!(?<!{w})(?i:{a}))".format(
    w=_WORD, a="|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
)
_NOT_INITIAL = f"(?<!(?<!{_WORD})[A-Z])"
_NOT_DOTTED_NUMBER = rf"(?<!\.{_WORD}{{0,255}}[0-9])"
_CLOSERS = "[\"'’”)\\]]*+"
# The end of a sentence: punctuation, closing marks and the white space after.
BOUNDARY_PATTERN = (
    r"(?sU)(?=[.!?])(?<![.!?])(?:"
    rf"\.*+[!?][.!?]*+{_CLOSERS}\s++"
    rf"|(?:\.{{2,}}+|{_NOT_ABBREVIATION}{_NOT_INITIAL}{_NOT_DOTTED_NUMBER}\.){_CLOSERS}\s++"
    r"(?!\W*+\p{IsLowercase}))"
)
_MARK = "\u0000"


def sentences(text: Column) -> Column:
    """Lossless sentence split: ``array_join(sentences(t), '') = t``.

    Ends are marked and split on; a text that already holds the mark takes the
    slower direct extraction instead.
    """
    marked = F.split(F.regexp_replace(text, BOUNDARY_PATTERN, f"$0{_MARK}"), _MARK)
    direct = F.regexp_extract_all(text, F.lit(rf"(?s)(.+?(?:{BOUNDARY_PATTERN}|\z))"), F.lit(1))
    return F.when(F.contains(text, F.lit(_MARK)), direct).otherwise(
        F.filter(marked, lambda piece: piece != "")
    )


_KEEPING = {
    "\n\n": "(?s).*?\n\n|.+$",
    "\n": "[^\n]*+\n|[^\n]++",
    " ": "[^ ]*+ |[^ ]++",
}


def split_keep(text: Column, separator: str) -> Column:
    """Split on a literal, leaving the separator on the piece before it."""
    return F.regexp_extract_all(text, F.lit(_KEEPING[separator]), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def values_in(text: Column, pattern: str = VALUE_PATTERN) -> Column:
    """Number-shaped tokens, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def clip(text: Column, limit: int, marker: str) -> Column:
    """Cut to ``limit`` characters and say so with ``marker``."""
    cut = rstrip(F.left(text, F.lit(limit)))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(marker))).otherwise(text)


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<think>.*?</think>", "")


def snippet(content: Column, query: Column, radius: int = 40) -> Column:
    """Window around the first match, with ellipses where text was cut."""
    at = F.instr(F.lower(content), F.lower(query)) - 1
    start = F.greatest(F.lit(0), at - radius)
    end = F.least(F.length(content), at + F.length(query) + radius)
    window = F.substring(content, start + 1, end - start)
    return F.when(at < 0, F.left(content, F.lit(radius * 2))).otherwise(
        F.concat(
            F.when(start > 0, "…").otherwise(""),
            window,
            F.when(end < F.length(content), "…").otherwise(""),
        )
    )
