"""Exact set-similarity join over word shingles, by prefix filtering (Chaudhuri et al., 2006; Xiao et al., 2008).

Put the shingles of every text in one order for all, rare ones first. Two texts
with a Jaccard similarity of t or more then share one of their first
n - ceil(t n) + 1 shingles, so these are the keys to meet at. What meets is
pruned by position and by parity bitmaps (Sandes et al., 2017), which never
lose a pair, and the rest is compared by its sets. No pair is missed and no
key is skipped or capped.

Components need no comparison inside themselves. First come the pairs that
SimHash links (``simhash.links``) and one pair a text with the first member of
a key, then the other first members of its keys, then pairs that still lie in
different components, a few a text at a time while they are many. Every pair is
checked by its sets, whoever proposed it.
The texts of a crowded key meet in cells of a few hundred, spread over tasks.
By turns a cell proposes for each text only the closest one of another
component; what lies in different components after that is compared in full, and
only pairs that the bitmaps allow leave a cell. A sample names the commonest
keys, and any other is noticed where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import released, runs, slices, sorted_by_key, whole_text
from corpusflow.llm.simhash import SHINGLE, components, fingerprint, links, shingle_set
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import staged

# Texts looked at for the order of shingles, and shingles whose count is kept;
# they steer the work only, any order gives the same pairs.
SAMPLE = 5_000
COUNTED = 1 << 20
# A key in more texts than this meets by a join spread over tasks.
CROWD = 256
# Texts of such a key that are compared with each other, or with as many others, in a task.
CELL = 256
# Texts outside the largest group of such a key that are few enough to compare all.
FEW = 32
# Bits of the smallest parity bitmap; larger sets have at least a bit for each member.
BITS = 1024
# Rows of keys looked at together.
BLOCK = 1 << 16
# Pairs of a text that are tried at a time while its group is still in many components.
EACH = 2


def prefix(size: int, similarity: float) -> int:
    """How many of the first shingles of a set are keys."""
    return size - math.ceil(similarity * size - 1e-6) + 1


def parity(own: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of shingles falls on b; bitmaps differ in no more bits than their sets do in members.

    The number of bits is a power of two that grows with the set, as a full bitmap tells nothing.
    """
    bits = max(BITS, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (one a row, whole 64-bit words) brought down to ``width`` words: halves are added without carry."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def bits_apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits the bitmaps of each row differ, at the smaller one's number of bits."""
    wide = [pa.compute.binary_length(c).to_numpy(zero_copy_only=False) // 8 for c in (x, y)]
    apart = np.zeros(len(x), dtype=np.int64)
    for a, b in set(zip(*(w.tolist() for w in wide))):
        at = np.flatnonzero((wide[0] == a) & (wide[1] == b))
        left, right = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), dtype=np.uint64).reshape(len(at), -1) for c in (x, y))
        apart[at] = np.bitwise_count(folded(left, min(a, b)) ^ folded(right, min(a, b))).sum(axis=1, dtype=np.int64)
    return apart


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met more than once in a sample of ``rows`` (body), and their counts scaled to all rows."""
    step = max(1, rows.count() // SAMPLE)

    def run(batches):
        for batch in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(b, words) for b in batch.column(0).to_pylist()]))], ["h"])

    some = rows.where(F.pmod(F.xxhash64("body", F.lit("sample")), F.lit(step)) == 0).select("body")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "h").limit(COUNTED).toArrow()
    hashes, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order] * step


def keyed(rows: DataFrame, words: int, similarity: float, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, sig, n, few, keys, bits, fp) per row.

    Equal sets have equal ``sig``; the first ``few`` keys are not crowded; ``fp``
    is the SimHash over ``shingle`` words as a signed 64-bit number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words))

    def run(batches):
        known, counts = shared.value
        for batch in slices(batches, 2):
            sig, n, few, keys, bits, fp = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, words)
                often = np.zeros(len(own), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, counts[at], 0)
                first = np.argsort(often, kind="stable")[: prefix(len(own), similarity)]
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                n.append(len(own))
                few.append(int(np.count_nonzero(often[first] <= CROWD)))
                keys.append(own[first])
                bits.append(parity(own))
                fp.append(fingerprint(text, shingle))
            prints = pa.array(np.array(fp, dtype=np.uint64).view(np.int64))
            made = [pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(few, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), prints]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "text_hash", "sig", "n", "few", "keys", "bits", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text_hash", "body").mapInArrow(run, f"id {kind}, text_hash long, sig binary, n int, few int, keys array<long>, bits binary, fp long")


def meetings(entries: DataFrame, similarity: float) -> DataFrame:
    """Who meets at the keys of ``entries`` (key, u, n, pos).

    Rows (a, b, star): pairs that share a key and may be similar, ``star`` with
    the first of the key. Entries of keys of more than ``CROWD`` texts come back
    as they are (key, u as a, n, pos; b is null), so no task pairs up a crowd.
    """
    share = similarity / (1 + similarity)
    names = ["a", "b", "star", "key", "n", "pos"]

    def entered(key, u, n, pos):
        if len(key):
            none = pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(u), *none, pa.array(key), pa.array(n), pa.array(pos)], names)

    def pairs(key, u, n, pos):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(np.append(starts, len(key)))
        many = np.repeat(lengths > CROWD, lengths)
        yield from entered(key[many], u[many], n[many], pos[many])
        key, u, n, pos = (c[~many] for c in (key, u, n, pos))
        if not len(key):
            return
        left = n - pos
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at, step = np.flatnonzero(~first) - 1, 1
        while at.size:
            to = at + step
            good = np.minimum(left[at], left[to]) >= share * (n[at] + n[to]) - 1e-6
            i, j = at[good], to[good]
            if i.size:
                ends = np.minimum(u[i], u[j]), np.maximum(u[i], u[j])
                none = pa.nulls(i.size, pa.int64()), pa.nulls(i.size, pa.int32()), pa.nulls(i.size, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(first[i]), *none], names)
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]

    def run(batches):
        held: list[list[np.ndarray]] = []
        size, passing = 0, None

        def flat():
            return [np.concatenate(c) for c in zip(*held)]

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if passing is not None:
                # More of a crowded key whose first entries have left already.
                cut = int(np.searchsorted(columns[0], passing, "right"))
                yield from entered(*(c[:cut] for c in columns))
                columns = [c[cut:] for c in columns]
            if not len(columns[0]):
                continue
            passing = None
            held.append(columns)
            size += len(columns[0])
            if size >= BLOCK:
                columns = flat()
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                if cut:
                    yield from pairs(*(c[:cut] for c in columns))
                rest = [c[cut:].copy() for c in columns]
                if len(rest[0]) > CROWD:
                    passing = rest[0][0]
                    yield from entered(*rest)
                    rest = [c[:0] for c in rest]
                held, size = [rest], len(rest[0])
        if size:
            yield from pairs(*flat())
        released()

    kept = sorted_by_key(entries, "key", "u").select("key", "u", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"))
    return kept.mapInArrow(run, "a long, b long, star boolean, key long, n int, pos int")


def possible(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose bitmaps do not rule the similarity out."""
    most = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in slices(batches, 2):
            apart = bits_apart(batch.column(2), batch.column(3))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most * batch.column(4).to_numpy() + 1e-6))

    left, right = sizes.toDF("a", "n", "x"), sizes.toDF("b", "m", "y")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("both"))
    return met.mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, heads: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` whose texts have a Jaccard similarity of word shingles of at least ``similarity``.

    ``rows`` holds each (id, text_hash) once. The sets of b travel to those of
    a, of which there are few: pairs of a key share its first text.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    wanted = heads.join(ends, "u").select("u", F.col("head.id").alias("_id"), F.col("head.text_hash").alias("_hash"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = rows.join(broadcast_if_small(wanted), same).select("u", "body")

    def shingles(batches):
        for batch in slices(batches, 1):
            own = [shingle_set(b, words) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["u", "own"])

    def compare(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = staged(texts.mapInArrow(shingles, "u long, own array<long>"))
    right = sets.withColumnsRenamed({"u": "b", "own": "y"}).join(broadcast_if_small(pairs), "b")
    firsts = broadcast_if_small(pairs.select(F.col("a").alias("u")).distinct())
    left = sets.join(firsts, "u", "left_semi").withColumnsRenamed({"u": "a", "own": "x"})
    return right.join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def shortened(maps: pa.Array) -> np.ndarray:
    """Bitmaps, one a row, at the smallest number of bits."""
    wide = pa.compute.binary_length(maps).to_numpy(zero_copy_only=False) // 8
    out = np.empty((len(maps), BITS // 64), dtype=np.uint64)
    for words in np.unique(wide).tolist():
        at = np.flatnonzero(wide == words)
        raw = b"".join(maps.take(pa.array(at)).to_pylist())
        out[at] = folded(np.frombuffer(raw, dtype=np.uint64).reshape(len(at), -1), BITS // 64)
    return out


def with_maps(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """``entries`` (key, u, n, pos, root) with short bitmaps."""

    def run(batches):
        for batch in slices(batches, 5):
            short = shortened(batch.column(5))
            maps = pa.array([row.tobytes() for row in short], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), maps], ["key", "u", "n", "pos", "root", "map"])

    wide = entries.join(sizes.select("u", "bits"), "u").select("key", "u", "n", "pos", "root", "bits")
    return wide.mapInArrow(run, "key long, u long, n int, pos int, root long, map binary")


def close(cells: DataFrame, similarity: float, closest: bool) -> DataFrame:
    """Pairs (a, b) of ``cells`` (cell, side, u, root, n, pos, map) in different groups that may be similar.

    Texts of side 0 meet those of side 1, and texts of side 2 each other. With
    ``closest`` each text proposes one other at most, else all pairs come back.
    """
    share, most = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def run(batches):
        for cell in runs(batches, "cell"):
            side, u, root, n, pos = (cell[c].to_numpy() for c in ("side", "u", "root", "n", "pos"))
            maps = np.frombuffer(b"".join(cell["map"].to_pylist()), dtype=np.uint64).reshape(len(u), -1)
            for one, other in ((0, 1), (2, 2)):
                x, y = np.flatnonzero(side == one), np.flatnonzero(side == other)
                if not (len(x) and len(y)):
                    continue
                apart = np.zeros((len(x), len(y)), dtype=np.int32)
                for word in maps.T:
                    apart += np.bitwise_count(word[x, None] ^ word[None, y])
                both = n[x, None] + n[None, y]
                fits = (root[x, None] != root[None, y]) & (apart <= most * both + 1e-6)
                fits &= np.minimum((n - pos)[x, None], (n - pos)[None, y]) >= share * both - 1e-6
                if closest:
                    i = np.flatnonzero(fits.any(axis=1))
                    j = np.where(fits[i], apart[i] / both[i], np.inf).argmin(axis=1)
                else:
                    i, j = np.nonzero(np.triu(fits, 1) if one == other else fits)
                if len(i):
                    ends = u[x[i]], u[y[j]]
                    found = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        released()

    kept = sorted_by_key(cells, "cell").select("cell", F.col("side").cast("int").alias("side"), "u", "root", "n", "pos", "map")
    return kept.mapInArrow(run, "a long, b long").distinct()


def key_sizes(entries: DataFrame) -> DataFrame:
    """(key, main, n_main, n_all, n_groups) of the keys of several groups: the largest group among the texts of a key, its texts, all texts and groups."""
    groups = entries.groupBy("key", "root").count()
    main = F.max_by(F.struct("root", "count"), F.struct("count", "root"))
    keys = groups.groupBy("key").agg(main.alias("m"), F.sum("count").alias("n_all"), F.count(F.lit(1)).alias("n_groups"))
    return keys.where("n_groups > 1").select("key", F.col("m.root").alias("main"), F.col("m.count").alias("n_main"), "n_all", "n_groups")


def rerooted(entries: DataFrame, group: DataFrame) -> DataFrame:
    """``entries`` with the groups that their roots are in by now; ``group`` has the (u, root) of who is in one."""
    top = group.select(F.col("u").alias("root"), F.col("root").alias("top"))
    return entries.join(top, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def crowd_turns(crowd: DataFrame, sizes: DataFrame, group: DataFrame, linked: Callable[[DataFrame], DataFrame], similarity: float) -> tuple[DataFrame, DataFrame]:
    """``group`` after linking close texts of crowded keys, and the entries that lie in different groups still.

    In a turn the texts of a key are dealt into cells, others each time, and a
    text tries the closest one of another group. A key takes part until few of
    its texts lie outside its largest group, or its groups do not get less by an
    eighth: then its texts do not link, and no pair may be left out.
    """
    own = staged(crowd.join(group, "u", "left").withColumn("root", F.coalesce("root", "u")))
    counts, turn = staged(key_sizes(own)), 0
    own = staged(with_maps(own.join(broadcast_if_small(counts.select("key")), "key", "left_semi"), sizes))
    while True:
        going = staged(counts.where(F.col("n_all") - F.col("n_main") > FEW).select("key", "n_all", F.col("n_groups").alias("were")))
        if not going.limit(1).count():
            return group, own
        parts = F.ceil(F.col("n_all") / F.lit(CELL))
        cell = F.xxhash64("key", F.pmod(F.xxhash64("u", F.lit(turn)), parts))
        cells = own.join(broadcast_if_small(going), "key").select(cell.alias("cell"), F.lit(2).alias("side"), "u", "root", "n", "pos", "map")
        group = staged(merged(group, linked(staged(close(cells, similarity, True)))))
        own = staged(rerooted(own, group))
        counts = key_sizes(own).join(broadcast_if_small(going.select("key", "were")), "key").where("8 * n_groups <= 7 * were")
        turn += 1


def crowd_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """All pairs of crowded keys in different groups that may be similar; ``entries`` are those of ``crowd_turns`` with their roots.

    Texts of the largest group of a key are only compared with the others. Both
    are dealt into parts, and a cell holds two parts of a key.
    """
    own = entries.join(broadcast_if_small(staged(key_sizes(entries))), "key")
    others, main = (F.ceil(n / F.lit(CELL)).cast("int") for n in (F.col("n_all") - F.col("n_main"), F.col("n_main")))
    part = F.pmod(F.xxhash64("u"), F.when(F.col("root") == F.col("main"), main).otherwise(others)).cast("int")

    def cells(upto: Column, made: Callable[[Column], tuple[Column, Column]]) -> Column:
        def one(j: Column) -> Column:
            cell, side = made(j)
            return F.struct(cell.alias("cell"), side.cast("int").alias("side"))

        return F.transform(F.sequence(F.lit(0), upto - 1), one)

    i = F.col("part")
    among = cells(others, lambda j: (F.xxhash64("key", F.least(i, j), F.greatest(i, j)), F.when(i == j, 2).when(i < j, 0).otherwise(1)))
    with_main = cells(main, lambda j: (F.xxhash64("key", i, j, F.lit("main")), F.lit(0)))
    as_main = cells(others, lambda j: (F.xxhash64("key", j, i, F.lit("main")), F.lit(1)))
    at = F.explode(F.when(F.col("root") == F.col("main"), as_main).otherwise(F.concat(among, with_main)))
    dealt = own.withColumn("part", part).select("u", "root", "n", "pos", "map", at.alias("at"))
    return close(dealt.select("at.cell", "at.side", "u", "root", "n", "pos", "map"), similarity, False)


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ``prints`` (u, fp) that connect all whose fingerprints SimHash links.

    Equal fingerprints meet at their smallest u, others by the generalised pigeonhole principle.
    """
    lead = staged(prints.groupBy("fp").agg(F.min("u").alias("lead")))
    known = broadcast_if_small(lead)
    equal = prints.join(known, "fp").where("lead < u").select(F.col("lead").alias("a"), F.col("u").alias("b"))
    near = staged(links(lead.select("fp"))).toDF("x", "y")
    near = near.join(known.toDF("x", "p"), "x").join(known.toDF("y", "q"), "y")
    return equal.unionByName(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def rooted(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) in different groups, with their roots (ra, rb); ``group`` has the (u, root) of who is in one."""
    met = pairs.join(group.toDF("a", "ra"), "a", "left").join(group.toDF("b", "rb"), "b", "left")
    return met.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")


def merged(group: DataFrame, pairs: DataFrame) -> DataFrame:
    """``group`` (u, root) after linking ``pairs`` (a, b): only roots are joined, once for each two groups."""
    between = rooted(pairs, group).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    above = staged(components(between)).toDF("root", "top")
    moved = group.join(broadcast_if_small(above), "root", "left").select("u", F.coalesce("top", "root").alias("root"))
    alone = above.join(group.select(F.col("u").alias("root")), "root", "left_anti")
    return moved.unionByName(alone.toDF("u", "root"))


def picked(pairs: DataFrame, turn: int, each: int = EACH) -> DataFrame:
    """Up to ``each`` of the ``pairs`` (a, b) of every a and of every b, others in every turn."""

    def of(end: str, other: str) -> DataFrame:
        least = [F.min(F.struct(F.xxhash64("a", "b", F.lit(turn * each + i)), other))[other] for i in range(each)]
        return pairs.groupBy(end).agg(F.array(*least).alias("_met")).select(end, F.explode("_met").alias(other)).select("a", "b")

    return of("a", "b").unionByName(of("b", "a")).distinct()


def joined_by_turns(pairs: DataFrame, group: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``group`` after trying ``pairs`` (a, b) a few a text at a time, and the pairs that still have to be compared.

    ``linked`` gives those of some pairs that link. Texts of a large group link
    over a few pairs each, and then all other pairs of them lie inside one
    component. Turns end when the rest is in proportion to its texts, or does
    not get less by half: then its texts do not link, and no pair may be left out.
    """
    left, turn = staged(pairs), 0
    while True:
        n, firsts, seconds = left.agg(F.count(F.lit(1)), F.countDistinct("a"), F.countDistinct("b")).first()
        if n <= 2 * EACH * (firsts + seconds):
            return group, left
        some = staged(picked(left, turn))
        group = staged(merged(group, linked(some)))
        left = staged(rooted(left, group).select("a", "b").join(some, ["a", "b"], "left_anti"))
        turn += 1
        if 2 * left.count() > n:
            return group, left


def similar_texts(docs: DataFrame, similarity: float, words: int = 5, id_column: str = "doc_id", text: str | Column = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp (SimHash over ``shingle`` words), component_id, kept.

    Texts link when their sets of ``words``-word shingles have a Jaccard
    similarity of at least ``similarity`` (above 0), whatever else they share.
    Null text counts as empty; a text of fewer words is one shingle.

    ``component_id`` is the smallest id reachable over links. One row of each
    component is kept: that of the smallest id (rows of one id: the one with
    the smaller text hash; equal rows are kept together). Null ids come last.
    """
    body = whole_text(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))
    own = staged(keyed(rows, words, similarity, shingle).withColumn("u", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("late"), "id", "text_hash")
    heads = staged(own.groupBy("sig").agg(F.min("u").alias("u"), F.min(order).alias("head")))
    repeats = own.select("u").join(heads.select("u"), "u", "left_anti")
    one = own.join(broadcast_if_small(staged(repeats)), "u", "left_anti")
    sizes = one.select("u", "n", "bits")
    if own.groupBy("id", "text_hash").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "text_hash"])

    regular = one.select("u", "n", F.posexplode(F.slice("keys", F.lit(1), F.col("few"))).alias("pos", "key"))
    crowd = one.where(F.col("few") < F.size("keys")).select(
        "u", "n", "few", F.posexplode(F.slice("keys", F.col("few") + 1, F.size("keys") - F.col("few"))).alias("pos", "key")
    )
    found = staged(meetings(regular, similarity))
    met = staged(found.where("b is not null").groupBy("a", "b").agg(F.max("star").alias("star")))
    more = found.where("b is null").select("key", F.col("a").alias("u"), "n", "pos")
    crowd = staged(crowd.select("key", "u", "n", (F.col("pos") + F.col("few")).alias("pos")).unionByName(more))

    first = broadcast_if_small(staged(crowd.groupBy("key").agg(F.min(F.struct("u", "n", "pos")).alias("first"))))
    share = similarity / (1 + similarity)
    fits = F.least(F.col("n") - F.col("pos"), F.expr("first.n - first.pos")) >= F.lit(share) * (F.col("n") + F.col("first.n")) - 1e-6
    stars = crowd.join(first, "key").where(F.col("first.u") < F.col("u")).where(fits).select(F.col("first.u").alias("a"), F.col("u").alias("b")).distinct()
    near = staged(met.where("star").select("a", "b").unionByName(stars).distinct())
    proposed = fingerprint_pairs(staged(one.select("u", "fp"))).unionByName(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    tried = staged(possible(proposed.distinct(), sizes, similarity))
    group = staged(components(alike(tried, heads, rows, words, similarity)).withColumnRenamed("fp", "u"))

    # The other first members of a text's keys, where they lie in different components.
    others = rooted(near, group).select("a", "b").join(tried, ["a", "b"], "left_anti")
    again = staged(possible(others, sizes, similarity))
    group = staged(merged(group, alike(again, heads, rows, words, similarity)))

    def linked(pairs: DataFrame) -> DataFrame:
        return alike(staged(possible(pairs, sizes, similarity)), heads, rows, words, similarity)

    # Whoever still lies in different components is compared, too.
    group, entries = crowd_turns(crowd, sizes, group, linked, similarity)
    others = rooted(met.where("not star").select("a", "b"), group).select("a", "b").join(tried.unionByName(again), ["a", "b"], "left_anti")
    group, others = joined_by_turns(others, group, linked)
    others = staged(others.unionByName(crowd_pairs(staged(rerooted(entries, group)), similarity)).distinct())
    roots = staged(merged(group, linked(others)))
    member = heads.join(roots, "u").select("u", "root", "head")
    best = member.groupBy("root").agg(F.min("head").alias("best"))
    moved = staged(member.join(best, "root").select("u", "best"))
    head = heads.join(moved, "u", "left").select("sig", F.coalesce("best", "head").alias("head"))
    return own.select("id", "text_hash", "sig", "fp").join(head, "sig").select(
        F.col("id").alias(id_column),
        "text_hash",
        "fp",
        F.col("head.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept"),
    )
