"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words whose smallest period q fits into it a given
number of times. For each dyadic scale t, positions are selected by the hashes of
the t words after each position and the next t positions, so that equal contexts
of 2t words are selected alike and every t positions hold a selected one unless
they lie in a stretch of period t/3 or less (Kempa, Kociumaka, 2019). Neighbouring
selected positions with equal contexts propose their distance as a period, which
finds the periods from t to 2t; stretches of a period below the first scale are
detected by comparing words that far apart. Proposals are extended to both sides.

All documents of a batch lie one after another, so that every step is an array
operation; separators that occur once keep documents apart.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix64, ragged, released, slices, whole_text

MIN_LENGTH = 6
EXPONENT = 4
FIRST_SCALE = 4  # shorter periods are detected apart
SLICE_BYTES = 2 << 20
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words (binary), the number of each word, and words per text."""
    split = pc.ascii_split_whitespace(texts)
    flat, ends = split.flatten(), split.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    inner = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    coded = flat.filter(some).dictionary_encode()
    bounds = inner[ends - ends[0]]
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(bounds)


def repeated_tails(codes: np.ndarray, sizes: np.ndarray, ids: list) -> np.ndarray:
    """Words of the documents whose checksum ends in 0, with the tail that is to repeat put in."""
    out, ends = codes.copy(), np.cumsum(sizes)
    for doc, n, end in zip(ids, sizes.tolist(), ends.tolist()):
        if doc is None or not n:
            continue
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[end - n + a : end] = codes[end - n + a + np.arange(n - a) % p]
    return out


class Joined:
    """Documents one after another, a separator of its own after each, with hashes of 1, 2, 4, ... words."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.n = len(codes) + len(sizes)
        self.values = np.full(self.n, -1, dtype=np.int64)
        self.values[np.repeat(self.starts, sizes) + ragged(sizes)] = codes
        gap = self.values < 0
        self.values[gap] = -1 - np.arange(int(gap.sum()))
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.levels = [mix64(self.values.view(np.uint64), 1)]

    def level(self, k: int) -> np.ndarray:
        """Hash of the 2**k words from each position (what reaches over the end counts as nothing)."""
        while len(self.levels) <= k:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            ahead = np.concatenate([last[half:], np.zeros(min(half, self.n), dtype=np.uint64)])[: self.n]
            with np.errstate(over="ignore"):
                self.levels.append(mix64(last * np.uint64(3) ^ mix64(ahead, 2), 4))
        return self.levels[k]

    def stretch(self, length: int) -> np.ndarray:
        """Hash of ``length`` words from each position where so many are left in the table."""
        k = length.bit_length() - 1
        level = self.level(k)
        shift = length - (1 << k)
        if not shift:
            return level[: self.n - length + 1]
        with np.errstate(over="ignore"):
            return mix64(level[: self.n - length + 1] * np.uint64(5) ^ mix64(level[shift : shift + self.n - length + 1], 6), 7)

    def same_ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on (x < y)."""
        out = np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            fits = y + out + step <= self.n
            i, j = np.where(fits, x + out, 0), np.where(fits, y + out, 0)
            equal = fits & (self.levels[k][i] == self.levels[k][j])
            # At the highest level a stretch may go on for several steps.
            while equal.any():
                out += equal * step
                if k < len(self.levels) - 1:
                    break
                fits = equal & (y + out + step <= self.n)
                i, j = np.where(fits, x + out, 0), np.where(fits, y + out, 0)
                equal = fits & (self.levels[k][i] == self.levels[k][j])
        return out

    def same_behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x equal those before y (x < y)."""
        out = np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            equal = np.ones(len(x), dtype=bool)
            while True:
                fits = equal & (x - out - step >= 0)
                i, j = np.where(fits, x - out - step, 0), np.where(fits, y - out - step, 0)
                equal = fits & (self.levels[k][i] == self.levels[k][j])
                out += equal * step
                if k < len(self.levels) - 1 or not equal.any():
                    break
        return out


def next_equal(hashes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, the next position of the same hash) for ascending positions; those without one are left out."""
    if not len(positions):
        return positions, positions
    order = np.argsort(hashes, kind="stable")
    h, p = hashes[order], positions[order]
    same = h[1:] == h[:-1]
    return p[:-1][same], p[1:][same]


def in_short_period(joined: Joined, scale: int) -> np.ndarray:
    """For each position whether its ``scale`` words have a period of ``scale // 3`` or less."""
    n = joined.n - scale + 1
    out = np.zeros(n, dtype=bool)
    most = scale // 3
    if not most:
        return out
    # The first words recur within that distance, if the period is that short; then all do.
    core = joined.stretch(scale - most)
    at, then = next_equal(core[:n], np.arange(n))
    near = then - at <= most
    at, then = at[near], then[near]
    for d in np.unique(then - at).tolist():
        own = at[then - at == d]
        whole = joined.stretch(scale - d)
        out[own] = whole[own] == whole[own + d]
    return out


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each position."""
    least, have = values, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - have : width - have + len(values) - width + 1])


def synchronising_set(joined: Joined, scale: int) -> np.ndarray:
    """Selected positions: the least hash of the window stands at its first or its last place.

    Hashes of words in a stretch of short period take no part.
    """
    if joined.n < 2 * scale:
        return np.zeros(0, dtype=np.int64)
    ids = joined.stretch(scale).copy()
    ids[in_short_period(joined, scale)] = NOTHING
    least = window_least(ids, scale + 1)
    n = len(least)
    return np.flatnonzero((least != NOTHING) & ((ids[:n] == least) | (ids[scale : scale + n] == least)))


def proposals(joined: Joined, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): words from the position on recur that much later."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Regions of the shortest periods: where words equal those d ahead for long enough.
    for d in range(1, FIRST_SCALE):
        if joined.n <= d:
            continue
        same = np.concatenate([[False], joined.values[:-d] == joined.values[d:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= (exponent - 1) * d
        begin = begin[long]
        least = np.ones(len(begin), dtype=bool)
        for shorter in range(1, d):
            if d % shorter == 0:
                least &= ~np.all([joined.values[begin + i] == joined.values[begin + i + shorter] for i in range(d - shorter)], axis=0)
        found.append((begin[least], np.full(int(least.sum()), d)))
    scale = FIRST_SCALE
    longest = int(joined.sizes.max(initial=0))
    while exponent * scale <= longest:
        chosen = synchronising_set(joined, scale)
        context = joined.stretch(2 * scale)
        at, then = next_equal(context[chosen], chosen)
        gap = then - at
        fits = (gap >= scale) & (gap < 2 * scale)
        found.append((at[fits], gap[fits]))
        scale *= 2
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(codes: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, ordered by document, start and period.

    ``exponent`` is 4 at least: then every run holds two selected positions a period apart.
    """
    rows = []
    # Scales beyond a document's reach pass over words in vain: documents of about one length go together.
    kind = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), -1).astype(int)
    starts = np.cumsum(sizes) - sizes
    for k in np.unique(kind[kind >= 0]).tolist():
        docs = np.flatnonzero((kind == k) & (sizes >= min_length))
        if not len(docs):
            continue
        own = sizes[docs]
        joined = Joined(codes[np.repeat(starts[docs], own) + ragged(own)], own)
        at, period = proposals(joined, exponent)
        if not len(at):
            continue
        ahead = joined.same_ahead(at, at + period)
        behind = joined.same_behind(at, at + period)
        start, length = at - behind, behind + ahead + period
        long = length >= np.maximum(min_length, exponent * period)
        doc = joined.doc[at]
        rows.append(np.stack([docs[doc], start - joined.starts[doc], length, period], axis=1)[long])
    if not rows:
        return np.zeros((0, 4), dtype=np.int64)
    every = np.unique(np.concatenate(rows), axis=0)
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def digests(rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> list[list]:
    """Columns n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes
    gone = np.zeros(len(codes) + 1, dtype=np.int64)
    begin = starts[rows[:, 0]] + rows[:, 1]
    np.add.at(gone, begin + rows[:, 3], 1)
    np.add.at(gone, begin + rows[:, 2], -1)
    kept = np.cumsum(gone)[:-1] == 0
    order = np.lexsort((rows[:, 3], rows[:, 1], -rows[:, 2], rows[:, 0]))
    best = {}
    for i in order[::-1].tolist():
        best[int(rows[i, 0])] = i
    counts = np.bincount(rows[:, 0], minlength=n)
    edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
    lines = rows[:, 1:].tolist()
    out: list[list] = [[] for _ in range(7)]
    for d in range(n):
        a, b = int(starts[d]), int(starts[d] + sizes[d])
        own = codes[a:b][kept[a:b]] if counts[d] else codes[a:b]
        text = b" ".join([words[c] for c in own.tolist()])
        said = "".join("%d,%d,%d\n" % tuple(x) for x in lines[edges[d] : edges[d + 1]])
        top = lines[best[d]] if d in best else (None, None, None)
        milli = 1000 * top[1] // top[2] if d in best else None
        row = (int(counts[d]), *top, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        for column, value in zip(out, row):
            column.append(value)
    return out


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str | Column = "text",
    min_length: int = MIN_LENGTH,
    exponent: int = EXPONENT,
    repeat_tails: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_runs, the longest run, all runs, and digests of runs and kept words.

    Words are cut at ASCII white space. A run is a stretch of words of smallest
    period q that is ``exponent`` periods and ``min_length`` words long at least
    and that no neighbour extends. Words of a run after its first period are not
    kept. Of equally long runs the first is named, then that of smaller period.
    ``repeat_tails`` puts repetitions into documents chosen by the checksum of
    their id (never of null ids). Null or empty texts have no words and no runs
    and collapse to the empty text; rows of one id are rows like any other; an
    empty table gives an empty result. An exponent below 4 is refused.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 at least")
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"))

    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            ids = batch.column(0)
            different, codes, sizes = words_of(batch.column(1))
            if repeat_tails:
                codes = repeated_tails(codes, sizes, ids.to_pylist())
            found = runs_of(codes, sizes, min_length, exponent)
            words = different.cast(pa.binary()).to_pylist()
            columns = digests(found, codes, sizes, words)
            bounds = np.searchsorted(found[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)
            parts = [pa.array(found[:, i]) for i in (1, 2, 3)]
            spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            values = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), *values, spans], names)
        released()

    names = [id_column, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    return rows.mapInArrow(run, schema + "runs_sha256 string, collapsed_sha256 string, runs array<struct<start long, length long, period long>>")
