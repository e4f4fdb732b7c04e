"""Cutting one text by characters, as plain functions for Python workers.

The same cuts as the Column expressions of ``operators.chunking``, which build
every piece as a string of its own; here a piece is only the place it ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from corpusflow.functions import text as tx

_HORIZONTAL_RUN = re.compile(f"{tx.HORIZONTAL}+")
_UNUSUAL = re.compile(tx.HORIZONTAL.replace(" ", "", 1))
_LINE_EDGES = re.compile(" *\n *")
_MANY_LINES = re.compile("\n{3,}")
_FIRST_SPACE = re.compile("[ \n]")

# White space as Java's \s has it among Unicode classes.
_WHITE = "[\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CLOSED = rf"[\"'’”)\]]*+{_WHITE}++"
_ENDS = re.compile(rf"([.!?]++){_CLOSED}")
# The same for texts without other marks; a pattern that begins with a letter is found much faster.
_STOPS = re.compile(rf"(\.\.*+){_CLOSED}")
_WORD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.’'")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = frozenset("0123456789")
_SHORTENED = frozenset(tx.ABBREVIATIONS)
_SHORTENED_LENGTHS = tuple(sorted({len(a) for a in tx.ABBREVIATIONS}))
_LONGEST_SHORTENED = _SHORTENED_LENGTHS[-1]
_LOOK_BACK = 255
# Letters that equal an ASCII letter when case does not count.
_ASCII_CASE = str.maketrans({"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"})
_MARK = "\u0000"


def strings(values: pa.Array) -> list[str | None]:
    """The values; bytes that are no UTF-8 become the replacement character, as in the JVM."""
    try:
        return values.to_pylist()
    except UnicodeDecodeError:
        return [None if v is None else v.decode("utf-8", "replace") for v in values.cast(pa.binary()).to_pylist()]


def lists(rows: Iterable[list | None], build: Callable[[list], pa.Array]) -> pa.Array:
    """One list of each row; None stays null. ``build`` makes the array of all items."""
    offsets: list[int | None] = []
    items: list = []
    for row in rows:
        offsets.append(None if row is None else len(items))
        items.extend(row or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, len(items)], pa.int32()), build(items))


def _is_unusual(text: str) -> bool:
    """Whether there is other horizontal white space than spaces."""
    if not text.isascii():
        return _UNUSUAL.search(text) is not None
    return (
        "\t" in text or "\x0b" in text or "\f" in text
        or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    )


def normalize(text: str) -> str:
    """``text.normalize`` of one text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "  " in text or _is_unusual(text):
        text = _HORIZONTAL_RUN.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _LINE_EDGES.sub("\n", text)
    if "\n\n\n" in text:
        text = _MANY_LINES.sub("\n\n", text)
    return text.strip(tx.EACH_SPACE)


def _is_word(char: str) -> bool:
    """Java's \\w among Unicode classes, beyond ASCII."""
    kind = unicodedata.category(char)
    return (
        kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or char in "\u200c\u200d"
        or "\u24b6" <= char <= "\u24e9" or "\U0001f130" <= char <= "\U0001f149"
        or "\U0001f150" <= char <= "\U0001f169" or "\U0001f170" <= char <= "\U0001f189"
    )


def _goes_on(text: str, at: int) -> bool:
    """Whether the next word from ``at`` begins in lower case."""
    for place in range(at, len(text)):
        char = text[place]
        if char.isascii():
            if char.isalnum() or char == "_":
                return char.islower()
        elif _is_word(char):
            return char.islower()
    return False


def _is_stop(text: str, at: int) -> bool:
    """Whether the one full stop at ``at`` may end a sentence: no abbreviation, initial or dotted number before it."""
    word = text[text.rfind(" ", 0, at) + 1 : at]
    if word.isalnum() and word.isascii():
        # Nothing but a word stands there, which is nearly always so.
        if len(word) == 1 and word in _CAPITALS:
            return False
        return len(word) > _LONGEST_SHORTENED or word.lower() not in _SHORTENED
    if at == 0:
        return True
    last = text[at - 1]
    if last in _DIGITS:
        dot = text.rfind(".", max(0, at - 2 - _LOOK_BACK), at - 1)
        if dot >= 0 and _WORD_CHARS.issuperset(text[dot + 1 : at - 1]):
            return False
    elif last in _CAPITALS and (at == 1 or text[at - 2] not in _WORD_CHARS):
        return False
    for length in _SHORTENED_LENGTHS:
        if length > at:
            break
        if length == at or text[at - length - 1] not in _WORD_CHARS:
            if text[at - length : at].translate(_ASCII_CASE).lower() in _SHORTENED:
                return False
    return True


def sentence_ends(text: str) -> list[int]:
    """Where the sentences of ``text.sentences`` end, the last one left out if nothing marks its end."""
    # With the mark in it a text is extracted directly, and a sentence takes one character at least before its end.
    marked, begun = _MARK in text, 0
    out: list[int] = []
    mixed = "!" in text or "?" in text
    for found in (_ENDS if mixed else _STOPS).finditer(text):
        at, end = found.span()
        if marked and at == begun:
            continue
        run = found[1]
        if run == "." and not _is_stop(text, at):
            continue
        if not (mixed and ("!" in run or "?" in run)) and _goes_on(text, end):
            continue
        begun = end
        out.append(end)
    return out


def _ends_after(text: str, separator: str, start: int, stop: int) -> Iterator[int]:
    at = text.find(separator, start, stop)
    while at >= 0:
        at += len(separator)
        yield at
        if at >= stop:
            return
        at = text.find(separator, at, stop)
    yield stop


def windows(text: str, limit: int) -> list[int]:
    """Ends of the windows of at most ``limit`` characters that ``pack`` makes of the pieces of ``split_pieces``."""
    if limit <= 0:
        raise ValueError("chunk_overlap must be smaller than chunk_size.")
    size = len(text)
    if size <= limit:
        return [size] if size else []
    out: list[int] = []
    start = held = 0  # the open window: text[start:held]

    def take(end: int) -> None:
        """The piece text[held:end], which is no longer than the limit."""
        nonlocal start, held
        if end - start > limit:
            out.append(held)
            start = held
        held = end

    def take_words(end: int) -> None:
        """text[held:end] by words. Only the last space that fits is looked for."""
        nonlocal start, held
        while end - start > limit:
            space = text.rfind(" ", held, start + limit)
            if space >= 0:
                held = space + 1
                out.append(held)
                start = held
            elif start < held:
                out.append(held)
                start = held
            else:
                space = text.find(" ", start, end)
                word = end if space < 0 else space + 1
                while word - start > limit:
                    start += limit
                    out.append(start)
                held = word
        held = end

    for paragraph in _ends_after(text, "\n\n", 0, size):
        if paragraph - held <= limit:
            take(paragraph)
            continue
        for line in _ends_after(text, "\n", held, paragraph):
            if line - held <= limit:
                take(line)
                continue
            begin = held
            for end in (*sentence_ends(text[begin:line]), line - begin):
                end += begin
                if end == held:
                    continue
                if end - held <= limit:
                    take(end)
                else:
                    take_words(end)
    if start < size:
        out.append(size)
    return out


def chunks(text: str, size: int, overlap: int) -> list[str]:
    """``split_text`` of one text, measured in characters."""
    text = normalize(text)
    ends = windows(text, size - overlap)
    # Other white space than this is gone.
    if overlap == 0:
        return [chunk for start, end in zip([0, *ends], ends) if (chunk := text[start:end].strip(" \n"))]
    out, start = [], 0
    for end in ends:
        begin = max(0, start - overlap)
        # A broken word at the start of the repeated tail goes.
        space = _FIRST_SPACE.search(text, begin, start)
        if space and space.end() < start:
            begin = space.end()
        chunk = text[begin:end].strip(" \n")
        if chunk:
            out.append(chunk)
        start = end
    return out
