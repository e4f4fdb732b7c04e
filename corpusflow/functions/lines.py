"""The blocks of one Markdown or plain text, as a plain function for Python workers."""

from __future__ import annotations

import re

from corpusflow.functions import text as tx

MARKS = re.compile("[\x01-\x04]")
# A line begins after any line end that Java knows.
_LINE_START = r"(?:\A|(?<=[\n\x85\u2028\u2029]))"
FENCE_BLOCK = re.compile(
    rf"(?s){_LINE_START}[ \t]*([`~])\1\1[^\n]*(?:\n.*?{_LINE_START}[ \t]*\1\1\1[^\n]*|.*\Z)"
)
# White space and "any character" as Java has them.
_WHITE = r"[ \t\n\x0b\f\r]"
_ANY = r"[^\n\r\x85\u2028\u2029]"
ATX = re.compile(rf"(\#{{1,6}}){_WHITE}+({_ANY}*?){_WHITE}*\#*{_WHITE}*")
SETEXT = re.compile("=+|-{2,}")
TABLE_ROW = re.compile(rf"\|{_ANY}*\|")
TABLE_DIVIDER = re.compile(rf"\|(?:{_WHITE}|[:|-])+\|")
NO_HEADING = tuple("#-*+>|")
FENCES = ("```", "~~~")

Block = tuple[str, str, int | None]


def lines_of(text: str) -> list[tuple[str, bool]]:
    """Lines, and whether each is a whole fenced block. Fences are found in reading order, so the first mark decides what closes it."""
    text = MARKS.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    if FENCES[0] not in text and FENCES[1] not in text:
        return [(line, False) for line in text.split("\n")]
    out, at = [], 0
    for found in FENCE_BLOCK.finditer(text):
        out += [(line, False) for line in text[at : found.start()].split("\n")]
        out.append((found[0], True))
        at = found.end()
    return out + [(line, False) for line in text[at:].split("\n")]


def line_blocks(text: str) -> list[Block]:
    """``kind, text, level`` of every block, in order."""
    lines = lines_of(text)
    stripped = [line.strip(tx.EACH_SPACE) for line, _ in lines]
    out: list[Block] = []
    kind, held = "", []  # the open table or paragraph
    underlines = False  # the line before is a heading that this line underlines

    def close() -> None:
        nonlocal held
        if held:
            joined = "\n".join(held)
            if kind == "table":
                is_table = len(held) > 1 and TABLE_DIVIDER.fullmatch(held[1])
                out.append(("table" if is_table else "text", joined, None))
            else:
                out.append(("text", joined.strip(tx.EACH_SPACE), None))
            held = []

    last = len(lines) - 1
    for i, (line, fence) in enumerate(lines):
        s = stripped[i]
        if fence or underlines or not s:
            close()
            if fence:
                out.append(("text", line, None))
            kind, underlines = "", False
            continue
        if s[0] == "#" and (found := ATX.fullmatch(s)):
            close()
            out.append(("heading", found[2].strip(tx.EACH_SPACE), len(found[1])))
            kind = ""
            continue
        below = stripped[i + 1] if i < last and not lines[i + 1][1] else ""
        if below and below[0] in "=-" and s[0] not in NO_HEADING and SETEXT.fullmatch(below):
            close()
            out.append(("heading", s, 1 if below[0] == "=" else 2))
            kind, underlines = "", True
            continue
        now = "table" if s[0] == "|" and TABLE_ROW.fullmatch(s) else "text"
        if now != kind:
            close()
            kind = now
        held.append(s if now == "table" else line.rstrip(tx.EACH_SPACE))
    close()
    return out
