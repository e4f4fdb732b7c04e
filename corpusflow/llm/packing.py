"""Packing of token pieces into sequences of one length.

The number of pieces of each length is all that packing depends on, and there
are no more lengths than a sequence has places. The configuration linear
programme over that histogram is solved on the driver by multiplicative
weights: prices of lengths fall as they are covered, and a knapsack dynamic
programme prices configurations. The rounded plan is a bounded table from
(length, rank of a piece among those of its length) to places; ranks are
counted per task and task by task, so pieces never meet in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import ragged, slices, whole_text
from corpusflow.llm.wordbpe import word_tokenizer
from corpusflow.session import staged

SEQUENCE = 4096
END_ID = 1
# Pricing rounds, how sharply the price of a covered length falls, and by how
# much long pieces are dearer a token than short ones, which fill gaps later.
ROUNDS = 8
SHARPNESS = 0.6
LONG_FIRST = 0.05
# Bytes of text that a task encodes at once.
ENCODE_BYTES = 2 << 20
# Choices kept for each capacity; configurations are drawn from them.
CHOICES = 12


def priced(lengths: np.ndarray, prices: np.ndarray, capacity: int, choices: int) -> np.ndarray:
    """Knapsack programme: for each capacity the ``choices`` best last lengths (index, -1: none), best first."""
    best = np.zeros(capacity + 1)
    pick = np.full((capacity + 1, choices), -1, dtype=np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        n = np.searchsorted(lengths, room, side="right")
        value = prices[:n] + best[room - lengths[:n]]
        if n > choices:
            top = np.argpartition(value, n - choices)[n - choices :]
            top = top[np.argsort(-value[top], kind="stable")]
        else:
            top = np.argsort(-value, kind="stable")
        best[room] = value[top[0]]
        good = top[value[top] >= best[room] * (1 - 1e-3)]
        pick[room, : len(good)] = good
    return pick


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, seed: int = 7) -> dict[tuple[int, ...], float]:
    """A fractional cover of ``counts`` by configurations (tuples of indices of lengths, largest first)."""
    rng = np.random.default_rng(seed)
    covered = np.zeros(len(lengths))
    x: dict[tuple[int, ...], float] = defaultdict(float)
    for t in range(1, rounds + 1):
        # Multiplicative weights: the start price of a length is about its size.
        share = covered / counts
        prices = lengths / capacity * (1 + LONG_FIRST * lengths / capacity) * np.exp(-SHARPNESS * (share - (t - 1) / rounds))
        pick = priced(lengths, prices, capacity, CHOICES)
        known = (pick >= 0).sum(axis=1)
        for l in rng.permutation(len(lengths)).tolist():
            missing = counts[l] * t / rounds - covered[l]
            if missing <= 0:
                continue
            config, room = [l], capacity - int(lengths[l])
            while known[room]:
                offered = pick[room, : known[room]]
                behind = share_behind(offered, counts, covered, t / rounds)
                chosen = int(offered[behind])
                config.append(chosen)
                room -= int(lengths[chosen])
            key = tuple(sorted(config, reverse=True))
            own = key.count(l)
            x[key] += missing / own
            for i in key:
                covered[i] += missing / own
    return x


def share_behind(offered: np.ndarray, counts: np.ndarray, covered: np.ndarray, due: float) -> int:
    """The first offered length that is not yet covered as far as is due, else the least covered one."""
    share = covered[offered] / counts[offered]
    late = np.flatnonzero(share < due)
    return int(late[0]) if len(late) else int(share.argmin())


def rounded(x: dict[tuple[int, ...], float], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations, fullest first, and the rest by best fit on the histogram."""
    left = counts.astype(np.int64).copy()
    plan = []
    fill = {key: int(lengths[list(key)].sum()) for key in x}
    for key in sorted(x, key=lambda k: (-fill[k], -x[k], k)):
        need: dict[int, int] = defaultdict(int)
        for i in key:
            need[i] += 1
        times = min(int(np.ceil(x[key])), *(int(left[i]) // n for i, n in need.items()), 1 << 62)
        if times > 0 and fill[key] == capacity:
            plan.append((key, times))
            for i, n in need.items():
                left[i] -= n * times
    return plan + best_fit(lengths, left, capacity)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: bins of one content are handled together."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for l in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[l]), int(counts[l])
        while n:
            fits = np.flatnonzero(open_rooms[size:])
            if not len(fits):
                per = capacity // size
                whole, rest = divmod(n, per)
                for number, times in ((per, whole), (rest, 1)):
                    if number and times:
                        space = capacity - number * size
                        room[space].append(((l,) * number, times))
                        open_rooms[space] = True
                break
            space = size + int(fits[0])
            content, times = room[space].pop()
            used = min(times, n)
            if times > used:
                room[space].append((content, times - used))
            open_rooms[space] = bool(room[space])
            room[space - size].append((content + (l,), used))
            open_rooms[space - size] = True
            n -= used
    return [bin_ for bins in room for bin_ in bins]


def places(plan: list[tuple[tuple[int, ...], int]], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys (length << 40 | first rank) with their first sequence and offset."""
    seen: dict[int, int] = defaultdict(int)
    keys, sequences, offsets, base = [], [], [], 0
    for content, times in plan:
        at = 0
        for l in content:
            size = int(lengths[l])
            keys.append(size << 40 | seen[size])
            sequences.append(base)
            offsets.append(at)
            seen[size] += times
            at += size
        base += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(v, dtype=np.int64)[order] for v in (keys, sequences, offsets))


def pack_plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Contents (tuples of lengths) of sequences and how many there are of each."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[l] for l in lengths.tolist()], dtype=np.int64)
    plan = rounded(configurations(lengths, counts, capacity), lengths, counts, capacity)
    return [(tuple(int(lengths[i]) for i in content), times) for content, times in plan]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_column: str, text: str | Column) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with its rank among those of its length in its task."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"))

    def run(batches):
        tokenizer = word_tokenizer(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, 1, ENCODE_BYTES):
            ids, number = tokenizer.encode(batch.column(1))
            # The end id goes after the ids of each document.
            ended = np.insert(ids, np.cumsum(number), END_ID).astype("<u4")
            total = number + 1
            cuts = -(-total // capacity)
            row, piece = np.repeat(np.arange(len(total)), cuts), ragged(cuts)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            begin = (np.cumsum(total) - total)[row] + start
            raw = memoryview(ended).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            order = np.argsort(length, kind="stable")
            found, times = np.unique(length[order], return_counts=True)
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = np.repeat(seen[found], times) + ragged(times)
            seen[found] += times
            out = [batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(piece.astype(np.int32))]
            out += [pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(out, ["id", "part", "piece", "start", "length", "crc", "nth"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part int, piece int, start long, length long, crc long, nth long")


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, id_column: str = "doc_id", text: str | Column = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end id; only documents of more than
    ``capacity`` ids are cut. Null and empty texts are the end id alone. Rows
    of one id, null ids and equal texts are packed like any other; an empty
    table gives an empty result.
    """
    pieces = staged(token_pieces(docs, vocabulary, capacity, id_column, text))
    counts = staged(pieces.groupBy("part", "length").count())
    # At most ``capacity`` rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    lengths = np.array(sorted(histogram), dtype=np.int64)
    index = {int(l): i for i, l in enumerate(lengths)}
    plan = [(tuple(index[l] for l in content), times) for content, times in pack_plan(histogram, capacity)]
    keys, sequences, offsets = places(plan, lengths)

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "id", "piece", "start", "length", "crc", (F.col("base") + F.col("nth")).alias("rank")
    )
    # The plan's size is bounded by the rounds and lengths of the solver, not by the corpus.
    shipped = docs.sparkSession.sparkContext.broadcast((keys, sequences, offsets))

    def run(batches):
        keys, sequences, offsets = shipped.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            wanted = length << 40 | rank
            at = np.searchsorted(keys, wanted, side="right") - 1
            found = [pa.array(sequences[at] + wanted - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *found], [*names, "sequence_id", "offset"])

    names = [id_column, "piece", "start", "length", "ids_crc32"]
    kind = ranked.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
