"""Deduplication of lines that many documents share.

Lines are counted by 128-bit hash, pre-aggregated in each task. The hashes of
lines frequent enough to be dropped are sharded; each shard gets a minimal
perfect hash (three-way peeling, Botelho et al., 2007) over compact arrays of
fingerprints, counts and last documents. Documents probe those arrays; lines
are never joined with documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix64, runs, scaled, slices, sorted_by_key, whole_text
from corpusflow.llm.peeling import peel
from corpusflow.session import staged

MIN_CHARS = 40
MIN_DOCUMENTS = 5
SHARD_KEYS = 16_384
LEAST_SHARDS = 1_024
# Arrays of so many bytes are shipped to tasks at once; larger ones go in turns.
SHIPPED_BYTES = 128 << 20
# A null id is smaller than any other.
NO_ID = -(1 << 63)

ENTRY = "shard long, seed long, third long, choice binary, taken binary, prints binary, counts binary, lasts binary"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased (bytes methods do just that)."""
    return line.strip().lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= chars)


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def long_lines(text: bytes, chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """All lines, the numbers of those with a long key, and those keys' hashes."""
    lines = text.split(b"\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= chars:
            key = line_key(line)
            if long_enough(key, chars):
                at.append(i)
                hashes.append(line_hash(key))
    return lines, at, hashes


def halves(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)


def line_counts(rows: DataFrame, chars: int) -> DataFrame:
    """(h1, h2, documents, last): how many rows of (id, body) hold a line, and the largest id."""

    def run(batches):
        for batch in slices(batches, 1):
            seen: dict[bytes, list[int]] = {}
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = NO_ID if doc is None else doc
                for h in set(long_lines(body, chars)[2]):
                    entry = seen.get(h)
                    if entry is None:
                        seen[h] = [1, doc]
                    else:
                        entry[0] += 1
                        if doc > entry[1]:
                            entry[1] = doc
            if seen:
                both = halves(list(seen)).view(np.int64)
                numbers = np.array(list(seen.values()), dtype=np.int64)
                columns = [both[:, 0], both[:, 1], numbers[:, 0], numbers[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "n", "doc"])

    found = rows.mapInArrow(run, "h1 long, h2 long, n long, doc long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("documents"), F.max("doc").alias("last"))


def slots_of(h1: np.ndarray, h2: np.ndarray, seed, third) -> np.ndarray:
    """Keys x 3 slots, one in each third."""
    out = []
    seed, third = np.asarray(seed, dtype=np.uint64), np.asarray(third, dtype=np.uint64)
    for j in range(3):
        own = np.uint64(6) * seed + np.uint64(2 * j)
        h = mix64(h1, own) ^ mix64(h2, own + np.uint64(1))
        out.append(scaled(h, third) + (np.uint64(j) * third).astype(np.int64))
    return np.stack(out, axis=1)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, third, choice per slot, slot taken, own slot per key) for different pairs of hashes."""
    third = max(2, math.ceil(1.25 * len(h1) / 3) + 2)
    for seed in range(10_000):
        if seed % 20 == 19:
            third += max(1, third // 20)
        slots = slots_of(h1, h2, seed, third)
        rounds = peel(slots, 3 * third)
        if rounds is not None:
            choice = np.zeros(3 * third, dtype=np.int8)
            taken = np.zeros(3 * third, dtype=bool)
            own = np.zeros(len(h1), dtype=np.int64)
            for keys, slot in reversed(rounds):
                others = choice[slots[keys]].sum(axis=1)  # the own slot still holds zero
                choice[slot] = (slot // third - others) % 3
                taken[slot] = True
                own[keys] = slot
            return seed, third, choice, taken, own
    raise RuntimeError("no seed peels these hashes")


def shard_arrays(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> dict[str, object]:
    seed, third, choice, taken, own = perfect_hash(h1, h2)
    order = np.argsort(own)
    return {
        "seed": seed,
        "third": third,
        "choice": choice.tobytes(),
        "taken": np.packbits(taken).tobytes(),
        "prints": h2[order].astype("<u8").tobytes(),
        "counts": np.minimum(counts[order], 2**32 - 1).astype("<u4").tobytes(),
        "lasts": lasts[order].astype("<i8").tobytes(),
    }


def build_shards(frequent: DataFrame, shards: int) -> DataFrame:
    """One row of ENTRY for each shard that has lines."""

    def run(batches):
        for shard in runs(batches, "shard"):
            h1, h2, counts, lasts = (shard[c].to_numpy() for c in ("h1", "h2", "documents", "last"))
            row = shard_arrays(h1.view(np.uint64), h2.view(np.uint64), counts, lasts)
            yield pa.RecordBatch.from_pylist([{"shard": shard["shard"][0].as_py(), **row}])

    keyed = frequent.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return sorted_by_key(keyed, "shard").mapInArrow(run, ENTRY)


class LineTable:
    """The arrays of some shards, probed by many hashes at once."""

    def __init__(self, entries: list[dict], shards: int) -> None:
        self.shards = shards
        self.seed, self.third = np.zeros(shards, dtype=np.uint64), np.ones(shards, dtype=np.uint64)
        self.base, self.known = np.zeros(shards, dtype=np.int64), np.zeros(shards, dtype=bool)
        at, keys, choice, rank = 0, 0, [], []
        for e in entries:
            s, size = e["shard"], 3 * e["third"]
            self.seed[s], self.third[s], self.base[s], self.known[s] = e["seed"], e["third"], at, True
            choice.append(np.frombuffer(e["choice"], dtype=np.int8))
            taken = np.unpackbits(np.frombuffer(e["taken"], dtype=np.uint8))[:size]
            rank.append(keys + np.cumsum(taken, dtype=np.int64) - 1)
            at, keys = at + size, keys + int(taken.sum())
        join = lambda name, kind: np.frombuffer(b"".join(e[name] for e in entries), dtype=kind)
        self.choice = np.concatenate([*choice, np.zeros(3, dtype=np.int8)])
        self.rank = np.concatenate([*rank, np.zeros(3, dtype=np.int64)])
        self.prints, self.counts, self.lasts = join("prints", "<u8"), join("counts", "<u4"), join("lasts", "<i8")

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, documents, last document) for rows of (h1, h2)."""
        h1, h2 = hashes[:, 0], hashes[:, 1]
        if not len(self.prints) or not len(h1):
            return np.zeros(len(h1), dtype=bool), np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=np.int64)
        shard = np.mod(h1.view(np.int64), self.shards)
        third = self.third[shard]
        slots = slots_of(h1, h2, self.seed[shard], third) + self.base[shard][:, None]
        slots = np.where(self.known[shard][:, None], slots, len(self.choice) - 3)
        chosen = self.choice[slots].sum(axis=1) % 3
        at = np.minimum(self.rank[slots[np.arange(len(h1)), chosen]], len(self.prints) - 1)
        found = self.known[shard] & (at >= 0) & (self.prints[at] == h2)
        return found, self.counts[at].astype(np.int64), self.lasts[at]


def surplus(lookup: LineTable, docs: list[int | None], numbers: list[int], hashes: list[bytes], least: int) -> np.ndarray:
    """Which of the long lines go: ``numbers`` says how many of ``hashes`` belong to each document."""
    found, counts, lasts = lookup.probe(halves(hashes))
    ids = np.array([NO_ID if d is None else d for d in docs], dtype=np.int64)
    return found & (counts >= least) & (np.repeat(ids, numbers) < lasts)


def line_dedup(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    id_column: str = "doc_id",
    text: str | Column = "text",
    shipped_bytes: int = SHIPPED_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, kept_text, kept_sha256.

    Lines are cut at newlines; null or empty text is one empty line. A line
    whose key has at least ``min_chars`` code points and occurs in at least
    ``min_documents`` rows goes from all rows but those of the largest id that
    holds it. Repeated lines of a row count once and go or stay together; rows
    of the same id are separate documents of that id; null ids are smallest.
    An empty table gives an empty result.
    """
    body = whole_text(text)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), body.cast("binary").alias("body"))
    frequent = staged(line_counts(rows, min_chars).where(F.col("documents") >= min_documents))
    shards = max(LEAST_SHARDS, math.ceil(frequent.count() / SHARD_KEYS))
    entries = staged(build_shards(frequent, shards))
    size = sum(F.length(c) for c in ("choice", "taken", "prints", "counts", "lasts"))
    turns = max(1, math.ceil((entries.agg(F.sum(size)).first()[0] or 0) / shipped_bytes))
    context = docs.sparkSession.sparkContext

    def ship(turn: int):
        part = entries.where(F.pmod("shard", F.lit(turns)) == turn).collect()
        return context.broadcast([r.asDict() for r in part])

    schema = f"`{id_column}` long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
    if turns == 1:
        shipped = ship(0)

        def drop(batches):
            lookup = LineTable(shipped.value, shards)
            for batch in slices(batches, 1):
                ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                cut = [long_lines(b, min_chars) for b in bodies]
                gone = surplus(lookup, ids, [len(c[1]) for c in cut], [h for c in cut for h in c[2]], min_documents)
                at, drops = 0, []
                for _, numbers, _ in cut:
                    drops.append([n for n, g in zip(numbers, gone[at : at + len(numbers)].tolist()) if g])
                    at += len(numbers)
                yield kept_batch(batch.column(0), [c[0] for c in cut], drops, id_column)

        return rows.mapInArrow(drop, schema)

    # Turns: the lines that go are found by one part of the arrays after another.
    keyed = rows.withColumn("same", F.sha2("body", 256))

    def find(shipped):
        def run(batches):
            lookup = LineTable(shipped.value, shards)
            for batch in slices(batches, 1):
                cut = [long_lines(b, min_chars) for b in batch.column(1).to_pylist()]
                gone = surplus(lookup, batch.column(0).to_pylist(), [len(c[1]) for c in cut], [h for c in cut for h in c[2]], min_documents)
                at, hit, drops = 0, [], []
                for row, (_, numbers, _) in enumerate(cut):
                    own = [n for n, g in zip(numbers, gone[at : at + len(numbers)].tolist()) if g]
                    at += len(numbers)
                    if own:
                        hit.append(row)
                        drops.append(own)
                take = pa.array(hit, pa.int64())
                columns = [batch.column(0).take(take), batch.column(2).take(take), pa.array(drops, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "same", "drops"])

        return keyed.mapInArrow(run, "id long, same string, drops array<int>")

    found = None
    for turn in range(turns):
        part = find(ship(turn))
        found = part if found is None else found.unionByName(part)
    drops = found.groupBy("id", "same").agg(F.array_distinct(F.flatten(F.collect_set("drops"))).alias("drops"))
    drops = drops.withColumnsRenamed({"id": "drop_id", "same": "drop_same"})
    both = keyed.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("same") == F.col("drop_same")), "left")

    def apply(batches):
        for batch in slices(batches, 1):
            lines = [b.split(b"\n") for b in batch.column(1).to_pylist()]
            yield kept_batch(batch.column(0), lines, [d or [] for d in batch.column(2).to_pylist()], id_column)

    return both.select("id", "body", "drops").mapInArrow(apply, schema)


def kept_batch(ids: pa.Array, lines: list[list[bytes]], drops: list[list[int]], id_column: str) -> pa.RecordBatch:
    kept = []
    for own, gone in zip(lines, drops):
        if gone:
            away = set(gone)
            own = [line for i, line in enumerate(own) if i not in away]
        kept.append(b"\n".join(own))
    columns = [
        ids,
        pa.array([len(x) for x in lines], pa.int64()),
        pa.array([len(x) for x in drops], pa.int64()),
        pa.array(kept, pa.binary()).cast(pa.string()),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
    ]
    return pa.RecordBatch.from_arrays(columns, [id_column, "n_lines", "n_dropped", "kept_text", "kept_sha256"])
