"""License scan: ordered signature rules behind a keyword prefilter.

One pass of a keyword automaton over the words of a text says which rules can
match at all; only their regular expressions run. A detection inside another
one of higher priority, or of equal priority and greater length, is suppressed.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import slices, whole_text, worker_state
from corpusflow.llm.license_rules import BASE, PHRASE, Rule, build_rules

# Bytes of words stay (A-Z lower-cased, everything above ASCII), others become a space.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def spaced_words(text: bytes) -> tuple[str, int]:
    """The words with one space between and at both ends, and their number."""
    words = text.translate(WORDS).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} ", len(words)


def suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (start, end, priority, rule) without those inside a stronger one.

    Stronger: higher priority, or equal priority and longer, or equal in both
    and of an earlier rule. One sweep by start, the longest first, keeps the
    farthest end seen of each priority.
    """
    kept, farthest = [], {}
    group: list[tuple[int, int, int, int]] = []

    def settle() -> None:
        # Detections with the same start: longer ones may hold shorter ones too.
        for d in group:
            start, end, priority, rule = d
            held = any(e >= end for p, e in farthest.items() if p >= priority)
            held = held or any(
                o[1] >= end and (o[2] > priority or (o[2] == priority and (o[1] > end or (o[1] == end and o[3] < rule)))) for o in group
            )
            if not held:
                kept.append(d)
        for _, end, priority, _ in group:
            farthest[priority] = max(end, farthest.get(priority, -1))

    for d in sorted(set(found)):
        if group and d[0] != group[0][0]:
            settle()
            group = []
        group.append(d)
    settle()
    return kept


class Scanner:
    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.rules = rules if rules is not None else build_rules()
        self.behind: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for keyword in rule.keywords:
                self.behind.setdefault(f" {keyword}", []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword in self.behind:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()
        self.base = {i for i, rule in enumerate(self.rules) if rule.priority == PHRASE}

    def detections(self, words: str) -> list[tuple[int, int, int, int]]:
        """All matches of the rules whose keyword occurs: (start, end, priority, rule) in characters."""
        keywords = {k for _, k in self.automaton.iter(words)}
        if not keywords:
            return []
        found = []
        for i in sorted({i for k in keywords for i in self.behind[k]}):
            rule = self.rules[i]
            found += [(m.start(), m.end(), rule.priority, i) for m in rule.pattern.finditer(words)]
        return found

    def scan(self, text: bytes) -> tuple:
        """(words, base places, first word, last word, base labels, labels, score, spans)."""
        words, number = spaced_words(text)
        found = self.detections(words)
        if not found:
            return number, 0, None, None, "", "", 0.0, []
        base = sorted({d for d in found if d[3] in self.base})
        kept = suppressed(found)
        # Word numbers: spaces before the start, counted once along the text.
        place, at, count = {}, 0, 0
        for start in sorted({d[0] for d in [*base, *kept]} | {d[1] for d in kept}):
            count += words.count(" ", at, start)
            at = start
            place[start] = count
        base_labels = {self.rules[d[3]].label for d in base}
        labels = base_labels | {self.rules[d[3]].label for d in kept}
        starts = [place[d[0]] for d in base]
        spans = [(place[d[0]], place[d[1]], self.rules[d[3]].label, d[2]) for d in kept]
        score = max(d[2] for d in found) / PHRASE
        return (
            number, len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans,
        )


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<start: long, end: long, label: string, priority: long>>"
)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters
    beyond ASCII. ``n_base`` counts all places of the base phrases,
    ``first_word`` and ``last_word`` are the smallest and largest of their
    starts; base labels stay even inside stronger detections. Spans are the
    detections that are not suppressed, ends exclusive, in words. Null and empty
    texts have no words and score 0; rows of one id and null ids are rows like
    any other; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).cast("binary").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [part.split()[0] for part in SCHEMA.split(", spans")[0].split(", ")] + ["spans"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]

    def run(batches):
        scanner = worker_state("license_scanner", Scanner)
        for batch in slices(batches, 1):
            found = list(zip(*(scanner.scan(b) for b in batch.column(1).to_pylist())))
            fields = ("start", "end", "label", "priority")
            found[-1] = [[dict(zip(fields, s)) for s in own] for own in found[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], [id_column, *names])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, {SCHEMA}")
