"""Exact deduplication against immutable snapshots.

Digests of a snapshot are screened by binary-fuse filters (Graf and Lemire,
2022), one per digest shard, built once and stored beside the snapshot's exact
buckets. Duplicates inside the incoming batch are grouped on their own; of the
grouped digests only those that the filter lets through meet the buckets. Texts
behind one digest are compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix64, runs, scaled, sorted_by_key, whole_text
from corpusflow.llm.peeling import peel
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import staged

# Keys of one filter shard; bounds the memory of building and of screening.
SHARD_KEYS = 16_384
# Never fewer shards than this, so that small tables spread over tasks too.
LEAST_SHARDS = 4_096


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def key_of(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest (shorter ones padded) as unsigned numbers."""
    raw = b"".join(d[:8].ljust(8, b"\0") for d in digests.to_pylist())
    return np.frombuffer(raw, dtype="<u8")


def slots_of(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in three neighbouring segments, and the 8-bit fingerprint, of each key."""
    h = mix64(keys, seed)
    mask = np.uint64(segment - 1)
    first = scaled(h, segments * segment)
    second = (first + segment) ^ ((h >> np.uint64(18)) & mask).astype(np.int64)
    third = (first + 2 * segment) ^ (h & mask).astype(np.int64)
    return np.stack([first, second, third], axis=1), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, number of start segments, fingerprints) over ``keys``."""
    keys = np.unique(keys)
    n = max(2, len(keys))
    segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(room / segment) - 2)
    for seed in range(1_000):
        if seed % 50 == 49:
            segments += max(1, segments // 10)
        slots, prints = slots_of(keys, seed, segment, segments)
        rounds = peel(slots, (segments + 2) * segment)
        if rounds is not None:
            table = np.zeros((segments + 2) * segment, dtype=np.uint8)
            for members, own in reversed(rounds):
                three = table[slots[members]]  # the own slot still holds zero
                table[own] = prints[members] ^ three[:, 0] ^ three[:, 1] ^ three[:, 2]
            return seed, segment, segments, table
    raise RuntimeError("no seed peels these keys")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """True for every member; for others with probability 1/256."""
    slots, prints = slots_of(keys, seed, segment, segments)
    three = table[slots]
    return (three[:, 0] ^ three[:, 1] ^ three[:, 2]) == prints


def _filters(batches):
    """Filters of the shards of one partition."""
    for shard in runs(batches, "shard"):
        seed, segment, segments, table = build_filter(key_of(shard["digest"]))
        yield pa.RecordBatch.from_pydict(
            {
                "shard": shard["shard"][:1].combine_chunks(),
                "seed": pa.array([seed], pa.int64()),
                "segment": pa.array([segment], pa.int64()),
                "segments": pa.array([segments], pa.int64()),
                "fingerprints": pa.array([table.tobytes()], pa.binary()),
            }
        )


def _screen(batches):
    """Rows of a shard arrive after its filter; without a filter nothing is positive."""
    for shard in runs(batches, "shard"):
        digests = shard.filter(pa.compute.is_valid(shard["digest"]))
        if digests.num_rows == 0:
            continue
        first = shard.select(["seed", "segment", "segments", "fingerprints"]).slice(0, 1).to_pylist()[0]
        if first["fingerprints"] is None:
            positive = np.zeros(digests.num_rows, dtype=bool)
        else:
            table = np.frombuffer(first["fingerprints"], dtype=np.uint8)
            positive = may_contain(key_of(digests["digest"]), first["seed"], first["segment"], first["segments"], table)
        out = digests.select(["digest", "id", "uid", "size"]).append_column("positive", pa.array(positive))
        yield from out.combine_chunks().to_batches()


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: its last row (largest id, ties by row) and its size."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("last"), F.count(F.lit(1)).alias("size"))


def write_snapshot(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Exact buckets, filters and shard number of ``rows(id, uid, digest)``; written once, never changed."""
    groups = staged(grouped(rows))
    shards = max(LEAST_SHARDS, math.ceil(groups.count() / SHARD_KEYS))
    buckets = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    filters = sorted_by_key(buckets.select("shard", "digest"), "shard").mapInArrow(
        _filters, "shard long, seed long, segment long, segments long, fingerprints binary"
    )
    return buckets, staged(filters), shards


def screened(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``groups`` with ``positive``: false only where the digest is not in the snapshot."""
    keyed = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    flat = keyed.select("shard", "digest", F.col("last.id").alias("id"), F.col("last.uid").alias("uid"), "size")
    together = flat.unionByName(filters, allowMissingColumns=True).withColumn("later", F.col("digest").isNotNull())
    schema = f"digest binary, id {flat.schema['id'].dataType.simpleString()}, uid long, size long, positive boolean"
    found = sorted_by_key(together, "shard", "later").mapInArrow(_screen, schema)
    return found.select("digest", F.struct("id", "uid").alias("last"), "size", "positive")


def _merged(fresh: DataFrame, buckets: DataFrame) -> DataFrame:
    """Classes of incoming and stored digests together; only positives meet the buckets."""
    new = fresh.where("positive").select("digest", F.col("last").alias("new_last"), F.col("size").alias("new_size"))
    both = buckets.join(new, "digest", "full_outer").select(
        "digest",
        F.greatest("last", "new_last").alias("last"),
        (F.coalesce("size", F.lit(0)) + F.coalesce("new_size", F.lit(0))).alias("size"),
    )
    return both.unionByName(fresh.where("not positive").select("digest", "last", "size"))


def exact_dedup(
    docs: DataFrame,
    is_new: Column | None = None,
    id_column: str = "doc_id",
    text: str | Column = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest (binary).

    ``is_new`` says which rows are the incoming batch; the others are the
    snapshot. By default the upper half of the range of ids is incoming.

    Null text counts as empty. Of equal texts the row with the largest id is
    kept (null ids are smallest); of rows with that same id exactly one. An
    empty table gives an empty result; further columns are left alone. Equal
    digests of different texts are told apart, whatever ``digest`` is.
    """
    source = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"))
    if is_new is None:
        low, high = source.agg(F.min("id"), F.max("id")).first()
        is_new = F.col("id") > F.lit(None if low is None else low + (high - low) // 2)
    else:
        source = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"), is_new.alias("_new"))
        is_new = F.col("_new")
    keyed = source.withColumn("digest", digest(F.col("body"))).withColumn("new", F.coalesce(is_new, F.lit(False)))
    rows = staged(keyed.select("id", "digest", "new", F.monotonically_increasing_id().alias("uid")))

    buckets, filters, shards = write_snapshot(rows.where("not new"))
    fresh = screened(grouped(rows.where("new")), filters, shards)
    copies = staged(_merged(fresh, buckets.select("digest", "last", "size")).where("size > 1"))

    # Byte check: all texts of a digest are equal when the least is the greatest.
    wanted = broadcast_if_small(copies.select("digest"))
    spans = keyed.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b"))
    collided = staged(spans.where("a <> b").select("digest"))
    clashes = collided.limit(1).count() > 0
    if clashes:
        copies = copies.join(collided, "digest", "left_anti")
        kept_rows = rows.join(collided, "digest", "left_anti")
    else:
        kept_rows = rows
    out = kept_rows.join(broadcast_if_small(copies), "digest", "left").select(
        "id",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.when(F.col("size").isNull(), True).otherwise(F.col("last.uid") == F.col("uid")).alias("kept"),
        "digest",
    )
    if clashes:
        out = out.unionByName(_by_text(keyed.join(collided, "digest", "left_semi")))
    return out.withColumnRenamed("id", id_column)


def _by_text(rows: DataFrame) -> DataFrame:
    """The same decision for colliding digests, keyed by the text itself."""
    rows = staged(rows.select("id", "digest", "body", F.monotonically_increasing_id().alias("uid")))
    groups = rows.groupBy("body").agg(F.max(F.struct("id", "uid")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "body").select(
        "id", F.col("last.id").alias("keep_id"), "group_size", (F.col("last.uid") == F.col("uid")).alias("kept"), "digest"
    )
