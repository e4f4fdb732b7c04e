"""SimHash near-duplicates by the generalised pigeonhole principle (Qin et al., 2018).

Bits that go together are put into the same partition. A pair within distance t
must, in at least one partition i, be within t_i, for any t_1..t_m that add up
to t - m + 1. A dynamic programme picks those thresholds from estimated
candidate counts; keys are probed per partition and candidates verified on all
64 bits. A bucket with too many fingerprints is cut again by the same principle
over the bits that its key does not hold, until it is small; no bucket is
skipped or capped.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import slices, whole_text
from corpusflow.session import staged

BITS = 64
SHINGLE = 3
DISTANCE = 2
PARTS = 3
# Fingerprints looked at to group bits and to estimate candidate counts; the
# sample steers the work only, every fingerprint is probed.
SAMPLE = 2_000
# Fingerprints of one bucket that are compared with each other in a task.
BUCKET = 256
# Levels of refinement; after the last one 13 bits are left, so that a bucket
# has at most 2**13 different fingerprints.
LEVELS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of a UTF-8 text over word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    parts = iter(parts)
    while block := [digest(p, seed) for p in itertools.islice(parts, 1 << 15)]:
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str | Column = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp) per row; ``fp`` is the fingerprint as a signed 64-bit number."""
    body = whole_text(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))

    def run(batches):
        for batch in slices(batches, 2):
            found = np.array([fingerprint(b, shingle) for b in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["id", "text_hash", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_parts(sample: np.ndarray, parts: int, bits: list[int]) -> list[list[int]]:
    """``bits`` in ``parts`` groups of like size, bits that go together in one group."""
    table = ((sample[:, None] >> np.array(bits, dtype=np.uint64)) & np.uint64(1)).astype(float)
    table -= table.mean(axis=0) if len(table) else 0
    norm = np.sqrt((table**2).sum(axis=0))
    likeness = np.abs(table.T @ table) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(likeness, 0)
    left, groups = list(range(len(bits))), []
    for g in range(parts):
        size = len(left) // (parts - g)
        group = [max(left, key=lambda b: likeness[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: likeness[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append([bits[b] for b in group])
    return groups


def thresholds(sample: np.ndarray, parts: list[list[int]], distance: int) -> list[int]:
    """A threshold per partition (-1: not probed), adding up to distance - parts + 1, of least estimated cost."""
    cost = np.zeros((len(parts), distance + 2))
    for i, bits in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in bits))
        apart = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask)
        pairs = max(1, sample.size * (sample.size - 1))
        for e in range(distance + 1):
            keys = _ball(len(bits), reach(e))
            share = max((np.count_nonzero(apart <= 2 * reach(e)) - sample.size) / pairs, _ball(len(bits), 2 * reach(e)) / 2 ** len(bits))
            cost[i, e + 1] = share + keys * 1e-6  # candidates of a fingerprint, and its probes
    total = distance + 1  # of the thresholds, each counted from -1
    best = {0: (0.0, [])}
    for i in range(len(parts)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for e in range(-1, distance + 1):
                if used + e + 1 <= total:
                    option = (so_far + cost[i, e + 1], [*chosen, e])
                    step[used + e + 1] = min(step.get(used + e + 1, option), option)
        best = step
    return best[total][1]


def reach(threshold: int) -> int:
    """How far around its own key each fingerprint is entered: two of them within the threshold share a key."""
    return (threshold + 1) // 2


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def linked(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs within ``distance`` that span every component of ``values``, near pairs first (Kruskal)."""
    n = len(values)
    block = max(1, (1 << 22) // n)
    ends = []
    for a in range(0, n, block):
        apart = np.bitwise_count(values[a : a + block, None] ^ values[None, :])
        x, y = np.nonzero(apart <= distance)
        later = x + a < y
        x, y = x[later], y[later]
        ends.append((x + a, y, apart[x, y]))
    x, y, d = (np.concatenate(e) for e in zip(*ends))
    order = np.argsort(d, kind="stable")
    parent = list(range(n))
    out = []
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        p, q = i, j
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[q] = p
            out.append((int(values[i]), int(values[j])))
    return out


def _verify(distance: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy().view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            edges: list[tuple[int, int]] = []
            for n in np.unique(sizes).tolist():
                at = starts[sizes == n]
                if n <= 32:  # many small buckets at once: only those with a link go on
                    keep = []
                    for some in np.array_split(at, max(1, len(at) * n * n // (1 << 20))):
                        block = flat[some[:, None] + np.arange(n)]
                        near = np.bitwise_count(block[:, :, None] ^ block[:, None, :]) <= distance
                        keep.append(some[near.sum(axis=(1, 2)) > n])
                    at = np.concatenate(keep)
                for s in at.tolist():
                    edges += linked(flat[s : s + n], distance)
            if edges:
                pairs = np.array(edges, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) within ``distance`` that connect all fingerprints so linked; near pairs come first.

    ``distinct`` has each fingerprint once in ``fp``. A bucket gives fewer pairs than it has members.
    """
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in some], dtype=np.int64).view(np.uint64)
    groups = bit_parts(sample, parts, list(range(BITS)))
    limits = thresholds(sample, groups, distance)

    keys = []
    used: list[list[int]] = []
    for bits, limit in zip(groups, limits):
        if limit < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        for k in range(reach(limit) + 1):
            for flips in itertools.combinations(bits, k):
                probe = own.bitwiseXOR(F.lit(signed(sum(1 << b for b in flips))))
                keys.append(F.struct(F.lit(len(used)).alias("part"), probe.alias("key")))
        used.append(bits)
    cand = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.key", "fp")
    # With many keys a fingerprint, and bits left that cut no further, buckets stay as they are.
    refine = max(limits) <= 0
    cand = staged(cand) if refine else cand

    found = None
    for level in range(1, LEVELS + 1):
        last = level == LEVELS or not refine
        hot = None if last else staged(cand.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"))
        dense = not last and hot.limit(1).count() > 0
        cold = cand.join(hot, ["part", "key"], "left_anti") if dense else cand
        lists = cold.groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        edges = lists.select("fps").mapInArrow(_verify(distance), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not dense:
            break
        # Only the crowded buckets go on: cut their members by the bits not in the key.
        next_used, choices = [], []
        for part, bits in enumerate(used):
            rest = [b for b in range(BITS) if b not in bits]
            own = []
            for sub in bit_parts(sample, distance + 1, rest):
                mask = F.lit(signed(sum(1 << b for b in sub)))
                own.append(F.struct(F.lit(len(next_used)).alias("part"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(mask)).alias("key")))
                next_used.append(bits + sub)
            choices.append(F.when(F.col("part") == part, F.array(*own)))
        crowded = cand.join(hot, ["part", "key"], "left_semi")
        cand = staged(crowded.select("fp", F.explode(F.coalesce(*choices)).alias("k")).select("k.part", "k.key", "fp"))
        used = next_used
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every end of ``edges``: alternating large and small stars (Kiveris et al., 2014).

    Every round is written to the shared folder, so a lost executor costs no
    more than the round.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        return out.distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = staged(edges.where("a <> b"))
    before = state(edges)
    while before[0]:
        edges = staged(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text (the whole sequence when it has fewer words)."""
    own = text.lower().split()
    parts = map(b" ".join, zip(*(own[i:] for i in range(words)))) if len(own) >= words else [b" ".join(own)]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(p) for p in parts], dtype=np.uint64)).view(np.int64)


def near_duplicates(
    docs: DataFrame,
    distance: int = DISTANCE,
    parts: int = PARTS,
    shingle: int = SHINGLE,
    similarity: float | None = None,
    compared: int = 5,
    id_column: str = "doc_id",
    text: str | Column = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp, component_id, kept.

    Fingerprints over ``shingle`` words link at ``distance`` differing bits or
    fewer. With ``similarity``, rows link by their texts: if the sets of
    ``compared``-word shingles have that Jaccard similarity or more. Fingerprints
    propose pairs first (at the module's distance); those too far apart in bits
    are found by their shingles, so no pair is missed.

    ``component_id`` is the smallest id reachable over links. Null text counts
    as empty, texts without words have fingerprint zero. One row of each
    component is kept: that of the smallest id (rows of one id: the one with
    the smaller text hash; equal rows are kept together). Null ids come last; a
    component of null ids alone has a null component_id. An empty table gives
    an empty result.
    """
    if similarity is not None:
        from corpusflow.llm.set_similarity import similar_texts  # which builds on this module

        return similar_texts(docs, similarity, compared, id_column, text, shingle)
    rows = staged(fingerprints(docs, id_column, text, shingle))
    order = F.struct(F.col("id").isNull().alias("late"), "id", "text_hash")
    heads = staged(rows.groupBy("fp").agg(F.min(order).alias("head")))
    found = links(heads.select("fp"), distance, parts)
    roots = staged(components(found))
    member = heads.join(roots, "fp").select("fp", "root", "head")
    best = member.groupBy("root").agg(F.min("head").alias("best"))
    moved = staged(member.join(best, "root").select("fp", "best"))
    head = heads.join(moved, "fp", "left").select("fp", F.coalesce("best", "head").alias("head"))
    return rows.join(head, "fp").select(
        F.col("id").alias(id_column),
        "text_hash",
        "fp",
        F.col("head.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept"),
    )
