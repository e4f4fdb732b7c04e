"""Spelling variants: words one edit apart, found by a variable-length gram index.

Grams of two to four letters form a dictionary: a longer gram belongs to it only
where the gram it extends is frequent (Li, Wang, Yang, 2007, "VGRAM"). A word is
decomposed into the longest dictionary gram at each of its positions. Each word
knows how many of its grams one edit can affect at most; all other grams stay,
so the lists of its rarest grams, one more than that bound, are merged. An edit
lies wholly before or wholly after a gram that it leaves alone, so a list is cut
by the text on the gram's other side. What meets in a list is verified.

Words are Latin-1 byte strings here: their letters are A-Z, a-z and U+00C0-U+00FF.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix64, ragged, released, slices, whole_text
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import staged

MIN_CHARS = 7  # shorter words may have no gram that an edit leaves alone
MIN_COUNT = 2
DOMINANCE = 10  # a form occurs so many times as often as its variant
TYPO_EVERY = 31

MIN_GRAM, MAX_GRAM = 2, 4
# Grams above this share of all positions are extended: at most so many for each
# length, with one child per letter, which bounds the dictionary that is shipped.
FREQUENT = 4_096
# Longer lists are cut by what is left of the word without one letter; those that
# are too long for one task are cut so before the shuffle.
CROWD = 64
TASK_ROWS = 20_000
LONG_REST = 256
ODD = 0x9E3779B97F4A7C15  # of the sums that stand for texts
START, END = 1, 2  # marks around a word
HEAD, TAIL = 0, 1  # sides: text up to the gram's end, text from its start

SLICE_BYTES = 4 << 20
CHUNK_ROWS = 40_000
CHUNK_PAIRS = 400_000
MATRIX_CHARS = 32
TABLED_CHARS = 256

_BETWEEN = re.compile(rb"[\x00-@\[-`{-\x7f]")
_LOWER = np.zeros(256, dtype=np.uint8)
for _c in range(ord("a"), ord("z") + 1):
    _LOWER[_c] = _LOWER[_c - 32] = _c


# -- words of texts ----------------------------------------------------------


def latin_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words (binary), the word number of every run of letters, and its text."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    # In UTF-8, U+00C0-U+00FF is C3 and one more byte; C3 begins nothing else.
    lead = data == 0xC3
    value = _LOWER[data]
    value[1:][lead[:-1]] = data[1:][lead[:-1]] + 0x40
    before = np.concatenate([[0], np.cumsum(~lead)])
    value = value[~lead]
    first = before[offsets[:-1] - offsets[0]]
    letter = value != 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    at = first[first < len(value)]
    begins[at] |= letter[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = np.cumsum(begins)[letter] - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(word))]).astype(np.int32)
    letters = value[letter]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(first, starts, side="right") - 1


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


@cache
def _crc_steps() -> np.ndarray:
    """[k, part, byte]: what a byte of a checksum becomes when k bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    state = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    out = [state]
    for _ in range(TABLED_CHARS):
        state = (state >> np.uint32(8)) ^ table[state & np.uint32(255)]
        out.append(state)
    return np.stack(out)


def followed(checksums: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of two strings, from that of each and the bytes of the second (at most TABLED_CHARS)."""
    steps, out = _crc_steps(), more.copy()
    for part in range(4):
        out ^= steps[lengths, part, (checksums >> np.uint32(8 * part)) & np.uint32(255)]
    return out


def counted_words(ids: list, texts: pa.Array, min_chars: int, typo_every: int) -> tuple[list[bytes], list[int]]:
    """Words of some texts with their counts, after the letters that are lost by checksum."""
    different, code, text = latin_words(texts)
    if not len(different):
        return [], []
    size = np.diff(np.frombuffer(different.buffers()[1], dtype=np.int32)[: len(different) + 1])
    long = np.flatnonzero(size >= min_chars)
    if not len(long):
        return [], []
    values = different.take(pa.array(long)).to_pylist()
    number = np.full(len(different), -1)
    number[long] = np.arange(len(long))
    code = number[code]
    some = code >= 0
    code, text = code[some], text[some]
    encoded = [utf8(v) for v in values]
    checks = np.array([zlib.crc32(e) for e in encoded], dtype=np.uint32)
    n_bytes = np.array([len(e) for e in encoded])
    heads = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    h = np.zeros(len(code), dtype=np.uint32)
    tabled = n_bytes[code] <= TABLED_CHARS
    h[tabled] = followed(heads[text[tabled]], checks[code[tabled]], n_bytes[code[tabled]])
    for k in np.flatnonzero(~tabled).tolist():
        h[k] = zlib.crc32(encoded[code[k]], int(heads[text[k]]))
    known = np.array([i is not None for i in ids])
    hit = (h % np.uint32(typo_every) == 0) & known[text]
    counts = Counter(dict(zip(values, np.bincount(code[~hit], minlength=len(values)).tolist())))
    lost = code[hit] * (1 << 32) + h[hit] % size[long][code[hit]].astype(np.uint32)
    for key, n in zip(*(x.tolist() for x in np.unique(lost, return_counts=True))):
        word, i = values[key >> 32], key & 0xFFFFFFFF
        if len(word) > min_chars:
            counts[word[:i] + word[i + 1 :]] += n
    found = [(w, n) for w, n in counts.items() if n]
    return [w for w, _ in found], [n for _, n in found]


def parted(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a slice; a single longer text in parts that end between words."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    if len(ids) > 1 or texts.nbytes <= 2 * SLICE_BYTES:
        yield ids, texts
        return
    body, at = texts[0].as_buffer().to_pybytes(), 0
    while at < len(body):
        stop = _BETWEEN.search(body, at + SLICE_BYTES)
        end = stop.end() if stop else len(body)
        yield ids, pa.array([body[at:end].decode()])
        at = end


def word_counts(docs: DataFrame, id_column: str, text: str | Column, min_chars: int, min_count: int, typo_every: int) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` letters that occur ``min_count`` times."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"))

    def run(batches):
        for ids, texts in (part for batch in slices(batches, 1, SLICE_BYTES) for part in parted(batch)):
            words, counts = counted_words(ids, texts, min_chars, typo_every)
            for a in range(0, len(words), CHUNK_ROWS):
                columns = [pa.array(words[a : a + CHUNK_ROWS], pa.binary()), pa.array(counts[a : a + CHUNK_ROWS], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    found = rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


# -- grams -------------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` rows or ``limit`` bytes of words."""
    held, n, size = [], 0, 0
    for batch in slices(batches, 0, limit):
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Marked:
    """Words between marks, one after another; ``grams[q]`` at each place that has ``q`` characters of its word."""

    def __init__(self, words: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), dtype=np.uint8)
        self.flat = flat
        self.sizes = np.array([len(w) + 2 for w in words])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        left = self.ends[self.word] - np.arange(len(flat))  # characters from here on
        padded = np.concatenate([flat, np.zeros(MAX_GRAM, dtype=np.uint8)]).astype(np.int64)
        self.grams: dict[int, np.ndarray] = {}
        self.fits: dict[int, np.ndarray] = {}
        code = padded[: len(flat)]
        for q in range(2, MAX_GRAM + 1):
            code = (code << 8) | padded[q - 1 : q - 1 + len(flat)]
            self.grams[q], self.fits[q] = code, left >= q


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n) over all places of all words; a gram's bytes are the digits of its number."""

    def run(batches):
        for table in chunks(batches):
            marked = Marked(table["word"].to_pylist())
            every = np.concatenate([marked.grams[q][marked.fits[q]] for q in marked.grams])
            grams, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], ["gram", "n"])

    return words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Grams:
    """The dictionary: sorted grams, their place by rarity, and whether longer ones extend them."""

    def __init__(self, grams: np.ndarray, rank: np.ndarray, extended: np.ndarray) -> None:
        self.grams, self.rank, self.extended = grams, rank, extended

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each gram, or -1."""
        if not len(self.grams):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        return np.where(self.grams[at] == codes, at, -1)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> Grams:
    """Pruned by frequency: a gram longer than two stays only if what it extends is frequent.

    At most ``frequent`` grams of each length are frequent and each has one child
    per letter, so the dictionary has a bound that does not depend on the words.
    """
    counts = staged(gram_counts(words))
    shortest = F.col("gram") < 1 << 8 * MIN_GRAM
    places = counts.where(shortest).agg(F.sum("n")).first()[0] or 0
    least = places / frequent
    parents = counts.where((F.col("n") > least) & (F.col("gram") < 1 << 8 * (MAX_GRAM - 1))).select(F.col("gram").alias("parent"))
    children = counts.join(F.broadcast(parents), F.shiftright("gram", 8) == F.col("parent")).select("gram", "n")
    rows = counts.where(shortest).unionByName(children.where(~shortest)).toArrow()
    grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.lexsort((grams, n))] = np.arange(len(order))
    return Grams(grams, rank, (n > least) & (grams < 1 << 8 * (MAX_GRAM - 1)))


class Decomposed:
    """Each place of each word with its gram; ``affected`` bounds the grams one edit can change."""

    def __init__(self, words: list[bytes], grams: Grams) -> None:
        self.marked = m = Marked(words)
        place = np.flatnonzero(m.fits[MIN_GRAM])
        size, row = np.full(len(place), MIN_GRAM), grams.find(m.grams[MIN_GRAM][place])
        for q in range(MIN_GRAM + 1, MAX_GRAM + 1):
            longer = np.flatnonzero(m.fits[q][place] & (size == q - 1))
            found = grams.find(m.grams[q][place[longer]])
            some = found >= 0
            size[longer[some]], row[longer[some]] = q, found[some]
        self.place, self.size, self.row = place, size, row
        self.word = m.word[place]
        # A gram changes with the characters it holds, and with the next one if a longer gram may begin like it.
        change = np.zeros(len(m.flat) + 1, dtype=np.int64)
        reach = np.minimum(place + size + grams.extended[row], m.ends[self.word])
        np.add.at(change, place, 1)
        np.add.at(change, reach, -1)
        cover = np.cumsum(change)[:-1]
        cover[m.starts] = 0  # nothing is edited before the first mark
        self.affected = np.maximum.reduceat(cover, m.starts)

    def rarest(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rarest ``affected + 1`` grams of each word (as rows of this object), and their order in the word."""
        order = np.lexsort((self.place, rank[self.row], self.word))
        nth = ragged(np.bincount(self.word, minlength=len(self.affected)))
        few = nth <= self.affected[self.word[order]]
        return order[few], nth[few]


def powers_of(most: int) -> np.ndarray:
    """ODD to the powers 0 to ``most``, as 64-bit numbers."""
    out = np.full(most + 1, ODD, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def context_hashes(m: Marked) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the text before each place, and from each place on, that equal texts share."""
    with np.errstate(over="ignore"):
        powers = powers_of(int(m.sizes.max()))
        value = mix64(m.flat.astype(np.uint64), 3)
        inside = np.arange(len(m.flat)) - m.starts[m.word]
        ahead = np.concatenate([[np.uint64(0)], np.cumsum(value * powers[inside])])
        back = np.concatenate([[np.uint64(0)], np.cumsum(value * powers[m.sizes[m.word] - 1 - inside])])
        return ahead, back


ENTRY = "key long, word binary, n long, facts long, plan long"
PLAN_CHARS = 61  # longer words have no plan
NO_PLAN = -1


def packed(cut: np.ndarray, affected: np.ndarray, nth: np.ndarray, side: int) -> np.ndarray:
    """One number: where the context ends, the bound, the gram's order in the word, and the side."""
    return (cut << 7 | affected << 4 | nth << 1 | side).astype(np.int64)


def plans(word: np.ndarray, inside: np.ndarray, size: np.ndarray, nth: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the places and sizes of its rarest grams in one number, a byte each and never zero."""
    out = np.zeros(len(sizes), dtype=np.int64)
    np.add.at(out, word, np.where(inside < 64, (inside << 2 | size - 1) << 8 * nth, 0))
    return np.where(sizes <= PLAN_CHARS, out, NO_PLAN)


def index_entries(words: DataFrame, grams: Grams) -> DataFrame:
    """Two list entries (text up to the gram, text from the gram on) for each rarest gram of each word."""
    shipped = words.sparkSession.sparkContext.broadcast((grams.grams, grams.rank, grams.extended))

    def run(batches):
        grams = Grams(*shipped.value)
        for table in chunks(batches):
            d = Decomposed(table["word"].to_pylist(), grams)
            m = d.marked
            chosen, nth = d.rarest(grams.rank)
            word, place, size = d.word[chosen], d.place[chosen], d.size[chosen]
            affected = d.affected[word]
            ahead, back = context_hashes(m)
            start, end = m.starts[word], m.ends[word]
            with np.errstate(over="ignore"):
                head = mix64(ahead[place + size] - ahead[start], 11) + mix64((place - start).astype(np.uint64), 12)
                tail = mix64(back[end] - back[place], 13) + mix64(size.astype(np.uint64), 14)
            # The rest of a word is what its mark-free text has after, or before, the cut.
            heads = packed(np.minimum(place + size - start - 1, end - start - 2), affected, nth, HEAD)
            tails = packed(np.maximum(place - start - 1, 0), affected, nth, TAIL)
            values = [table[c].combine_chunks() for c in ("word", "n")]
            plan = plans(word, place - start, size, nth, m.sizes)
            # No edit lies before the first mark or after the last one.
            for keys, facts, some in ((head, heads, place + size < end), (tail, tails, place > start)):
                take = pa.array(word[some])
                columns = [pa.array(keys[some].view(np.int64)), *(v.take(take) for v in values)]
                columns += [pa.array(facts[some]), pa.array(plan[word[some]])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "facts", "plan"])
        released()

    return words.select("word", "n").mapInArrow(run, ENTRY)


# -- merging and checking ----------------------------------------------------


class Letters:
    """A binary Arrow column as one array of bytes with offsets."""

    def __init__(self, words: pa.Array) -> None:
        n = len(words)
        self.offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        self.data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        self.size = np.diff(self.offsets)


def finer_keys(words: pa.Array, keys: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of what the rest of a word shares with any rest one edit away: itself, and itself without each one letter.

    Few words share one of these. Of rests above LONG_REST, the halves: one of them stays whole.
    """
    letters = Letters(words)
    cut, tail = facts >> 7, (facts & 1).astype(bool)
    begin = letters.offsets[:-1] + np.where(tail, 0, cut)
    size = np.where(tail, cut, letters.size - cut)
    short = np.flatnonzero(size <= LONG_REST)
    begin, n = begin[short], size[short]
    row = np.repeat(np.arange(len(short)), n)
    at = ragged(n)
    with np.errstate(over="ignore"):
        powers = powers_of(LONG_REST)
        less = np.uint64(pow(ODD, -1, 1 << 64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(letters.data[begin[row] + at].astype(np.uint64), 3) * powers[at])])
        last = np.cumsum(n)
        first = last - n
        here = np.arange(len(row))
        whole = sums[last] - sums[first]
        without = (sums[here] - sums[first[row]]) + (sums[last[row]] - sums[here + 1]) * less
        parent = keys[short].view(np.uint64)
        found = [mix64(parent ^ mix64(whole, 21), 22), mix64(parent[row] ^ mix64(without, 21), 22)]
    rows = [short, short[row]]
    long: list[tuple[int, int]] = []
    for i in np.flatnonzero(size > LONG_REST).tolist():
        word, c = words[i].as_py(), int(cut[i])
        rest = word[:c] if tail[i] else word[c:]
        for h in {len(rest) // 2, (len(rest) - 1) // 2}:
            for half in (b"<" + rest[:h], b">" + rest[len(rest) - h :]):
                long.append((i, xxhash.xxh3_64_intdigest(half, int(keys[i]) & 0xFFFFFFFFFFFFFFFF)))
    found.append(np.array([k for _, k in long], dtype=np.uint64))
    rows.append(np.array([i for i, _ in long], dtype=np.int64))
    every = np.concatenate(found).view(np.int64)
    order = np.lexsort((every, np.concatenate(rows)))
    row, key = np.concatenate(rows)[order], every[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])[: len(row)]
    return row[fresh], key[fresh]


def thinned(entries: DataFrame) -> DataFrame:
    """Entries of lists that are too long for one task, under finer keys."""

    def run(batches):
        for table in chunks(batches, TASK_ROWS):
            row, key = finer_keys(table["word"].combine_chunks(), table["key"].to_numpy(), table["facts"].to_numpy())
            for a in range(0, len(row), CHUNK_ROWS):
                take = pa.array(row[a : a + CHUNK_ROWS])
                columns = [pa.array(key[a : a + CHUNK_ROWS]), *(table[c].combine_chunks().take(take) for c in names[1:])]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "word", "n", "facts", "plan"]
    return entries.select("word", "key", "n", "facts", "plan").mapInArrow(run, ENTRY)


class Packed:
    """Words aligned at both ends, so that common ends are found for many pairs at once."""

    def __init__(self, words: pa.Array) -> None:
        letters = Letters(words)
        self.words, self.size = words, letters.size
        n = np.minimum(letters.size, MATRIX_CHARS)
        row, at = np.repeat(np.arange(len(n)), n), ragged(n)
        self.left = np.zeros((len(n), MATRIX_CHARS), dtype=np.uint8)
        self.left[row, at] = letters.data[letters.offsets[row] + at]
        self.right = np.zeros((len(n), MATRIX_CHARS), dtype=np.uint8)
        self.right[row, at] = letters.data[letters.offsets[row + 1] - 1 - at]

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one edit apart, letters in common at the left end, and at the right end) of pairs.

        Their lengths differ by one at most; words are different.
        """
        long = np.maximum(self.size[a], self.size[b])
        head = (self.left[a] != self.left[b]).argmax(axis=1)
        tail = (self.right[a] != self.right[b]).argmax(axis=1)
        near = head + tail >= long - 1
        for k in np.flatnonzero(long >= MATRIX_CHARS).tolist():
            near[k], head[k], tail[k] = common_ends(self.words[int(a[k])].as_py(), self.words[int(b[k])].as_py())
        return near, head, tail


def common_ends(a: bytes, b: bytes) -> tuple[bool, int, int]:
    """(exactly one letter put in, left out or replaced, letters in common at the left, and at the right)."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    ahead, back = np.flatnonzero(x[:n] != y[:n]), np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    head, tail = (int(d[0]) if len(d) else n for d in (ahead, back))
    return a != b and abs(len(a) - len(b)) <= 1 and head + tail >= max(len(a), len(b)) - 1, head, tail


def met_before(pack: Packed, plan: np.ndarray, nth: np.ndarray, side: np.ndarray, a: np.ndarray, b: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Whether near words share a list that comes before this one, so that each pair is given once.

    The order is that of the shorter word, or the one that is smaller where they first differ.
    """
    at = np.minimum(head, MATRIX_CHARS - 1)
    turn = (pack.size[a] > pack.size[b]) | ((pack.size[a] == pack.size[b]) & (pack.left[a, at] > pack.left[b, at]))
    s, t = np.where(turn, b, a), np.where(turn, a, b)
    length, shift = pack.size[s] + 2, pack.size[t] - pack.size[s]
    known = (plan[s] != NO_PLAN) & (plan[t] != NO_PLAN)
    out = np.zeros(len(a), dtype=bool)
    own = [plan[t] >> 8 * k & 255 for k in range(MAX_GRAM + 1)]
    for k in range(MAX_GRAM + 1):
        gram = plan[s] >> 8 * k & 255
        place, size = gram >> 2, (gram & 3) + 1
        for which, text, moved in ((HEAD, place + size <= head + 1, gram), (TAIL, place >= length - tail - 1, gram + (shift << 2))):
            earlier = (k < nth[s]) | ((k == nth[s]) & (which < side[s]))
            shared = (gram > 0) & text & earlier
            if shared.any():
                out |= shared & np.any([o == moved for o in own], axis=0)
    return out & known


def merged(table: pa.Table, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of ``table`` of pairs one edit apart that share a key; ``keys`` are in order, each for one of ``rows``.

    A pair is looked at only where the grams after this one can still reach what
    the bounds of both words leave untouched.
    """
    if not len(keys):
        return
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))
    rows = rows[np.repeat(sizes, sizes) > 1]
    sizes = sizes[sizes > 1]
    last = np.repeat(np.cumsum(sizes), sizes)
    if not len(rows):
        return
    # Only words that meet another are packed.
    used, place = np.unique(rows, return_inverse=True)
    take = pa.array(used)
    pack = Packed(table["word"].combine_chunks().take(take))
    facts, plan = table["facts"].to_numpy()[used], table["plan"].to_numpy()[used]
    side, nth, affected = facts & 1, facts >> 1 & 7, facts >> 4 & 7
    total = pack.size + 1  # grams of a word
    reach, least = total - nth, total - affected
    partners = last - np.arange(len(rows)) - 1
    parts = np.cumsum(partners) // CHUNK_PAIRS
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(parts)) + 1):
        a = np.repeat(part, partners[part])
        b = a + 1 + ragged(partners[part])
        x, y = place[a], place[b]
        fits = np.abs(pack.size[x] - pack.size[y]) <= 1
        fits &= np.minimum(reach[x], reach[y]) >= np.maximum(least[x], least[y])
        x, y = x[fits], y[fits]
        near, head, tail = pack.ends(x, y)
        x, y, head, tail = x[near], y[near], head[near], tail[near]
        once = ~met_before(pack, plan, nth, side, x, y, head, tail)
        yield used[x[once]], used[y[once]]


def near_pairs(entries: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n) in both directions; longer words are repeated where they share several keys."""

    def pairs_of(table: pa.Table):
        keys = table["key"].to_numpy()
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))
        members = np.repeat(sizes, sizes)
        few, many = np.flatnonzero(members <= crowd), np.flatnonzero(members > crowd)
        jobs = [(keys[few], few)]
        if len(many):
            words, facts = table["word"].combine_chunks().take(pa.array(many)), table["facts"].to_numpy()[many]
            row, key = finer_keys(words, keys[many], facts)
            order = np.argsort(key, kind="stable")
            jobs.append((key[order], many[row[order]]))
        word, n = table["word"].combine_chunks(), table["n"].combine_chunks()
        for own, rows in jobs:
            for a, b in merged(table, own, rows):
                both, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                yield pa.RecordBatch.from_arrays([word.take(both), word.take(other), n.take(other)], ["word", "near", "near_n"])

    def run(batches):
        held = None
        for table in chunks(batches):
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = table["key"].to_numpy()
            # The last key may go on in the next rows.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from pairs_of(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None:
            yield from pairs_of(held.combine_chunks())
        released()

    ordered = entries.select("word", "key", "n", "facts", "plan").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "word binary, near binary, near_n long")


def near_words(words: DataFrame, frequent: int = FREQUENT, crowd: int = CROWD, task_rows: int = TASK_ROWS) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) that are one edit apart, in both directions.

    Words have at least MIN_CHARS letters and are different.
    """
    grams = gram_dictionary(words, frequent)
    entries = staged(index_entries(words, grams))
    crowded = staged(entries.groupBy("key").count().where(F.col("count") > task_rows).select(F.col("key").alias("crowded")))
    few = broadcast_if_small(crowded)
    same = F.col("key") == F.col("crowded")
    plain = entries.join(few, same, "left_anti")
    cut = thinned(entries.join(few, same, "left_semi"))
    found = near_pairs(plain.unionByName(cut), crowd)
    return found.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last one, doubling the steps."""
    found = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        step = found.join(ahead, F.col("root") == F.col("_at"), "left")
        step = staged(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        found = step.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str | Column = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE,
    typo_every: int = TYPO_EVERY,
    frequent: int = FREQUENT,
    crowd: int = CROWD,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters A-Z, a-z, U+00C0-U+00FF, with A-Z lower-cased and
    one letter lost where the checksum of id and run says so. A word's form is
    the word one edit away that occurs most often (ties: first by code points),
    if it does so at least ``dominance`` times as often; the root is the last
    form of forms. Null texts have no words; runs of a null id lose no letter;
    rows of one id and equal rows are counted each; texts and words of any
    length are taken whole; an empty table gives an empty result.
    ``min_chars`` below 7 is refused: shorter words may share no gram.
    """
    if min_chars < MIN_CHARS:
        raise ValueError(f"min_chars must be {MIN_CHARS} at least")
    words = staged(word_counts(docs, id_column, text, min_chars, min_count, typo_every))
    near = near_words(words, frequent, crowd, task_rows)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    most = -F.col("best.col1")
    taken = most >= dominance * F.col("n")
    chosen = staged(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"),
            F.when(taken, most).alias("form_n"),
        )
    )
    roots = rooted(chosen.where("form is not null")).withColumnRenamed("word", "_word")
    found = chosen.join(roots, F.col("word") == F.col("_word"), "left")
    name = lambda c: F.decode(c, "ISO-8859-1")
    return found.select(
        name("word").alias("word"), name("form").alias("form"), name(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n"
    )
