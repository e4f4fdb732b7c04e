"""Exact and approximate cosine search.

``chunks`` has ``chunk_id`` and ``embedding`` (array of float), ``queries`` has ``query_id`` and ``embedding``. Every task multiplies its chunk
batches with the query matrix and keeps only its own best ``k`` per query, so
neither all pairs nor any chunk vector is ever shuffled. The query matrix is
shipped to the tasks only behind a size check; a larger batch of questions is
laid out as a grid of bounded cells instead.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.keyword import rank_topk, require_positive
from corpusflow.operators.sizing import at_most
from corpusflow.operators.topk import Best, id_array, result_schema

# At 1024 dimensions of float64 this many query vectors are 160 MB.
MAX_SHIPPED_QUERIES = 20_000
# Bits of a binary sketch, and how many may differ: about an eighth of pairs without structure pass.
SKETCH_BITS, SKETCH_RADIUS = 512, 228
CELL_QUERIES = 4_000
CELL_CHUNKS = 50_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, for row-wise use."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit(vector: Column) -> Column:
    """Vector scaled to length one; done once at write."""
    squares = F.transform(vector, lambda v: v.cast("double") * v.cast("double"))
    norm = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
    return F.transform(vector, lambda v: v.cast("double") / norm)


def _matrix(rows: Iterable) -> np.ndarray:
    """Stack vectors and scale every row to length one."""
    stacked = np.asarray(list(rows), dtype=np.float64)
    if stacked.size == 0:
        return stacked.reshape(len(stacked), 0)
    norms = np.linalg.norm(stacked, axis=1, keepdims=True)
    return stacked / np.where(norms == 0, 1.0, norms)


def _arrow_matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    stacked = flat.reshape(rows, -1)
    norms = np.linalg.norm(stacked, axis=1, keepdims=True)
    return stacked / np.where(norms == 0, 1.0, norms)


def _local_topk(best: Best, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray) -> None:
    step = max(1, 4_000_000 // max(1, len(queries)))
    for start in range(0, len(ids), step):
        part = slice(start, start + step)
        scores = queries @ vectors[part].T
        best.add(scores, ids[part])


def _sides(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = chunks.filter(F.col("embedding").isNotNull()).select(
        "chunk_id", "embedding"
    )
    right = queries.filter(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("bigint"), "embedding"
    )
    return left, right


def _shipped(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.collect()  # bounded by MAX_SHIPPED_QUERIES
    query_ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    payload = chunks.sparkSession.sparkContext.broadcast((query_ids, _matrix(r["embedding"] for r in rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, matrix = payload.value
        best = Best(len(ids_q), k)
        for batch in batches:
            if batch.num_rows == 0 or len(ids_q) == 0:
                continue
            vectors = _arrow_matrix(batch.column("embedding"), batch.num_rows)
            _local_topk(best, id_array(batch.column("chunk_id")), vectors, matrix)
        kept = best.batch(ids_q)
        if kept is not None:
            yield kept

    return chunks.mapInArrow(score, result_schema(chunks))


def _grid(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every (chunk cell, query cell) pair is one bounded group."""
    n_chunks, n_queries = chunks.count(), queries.count()
    chunk_cells = max(1, -(-n_chunks // CELL_CHUNKS))
    query_cells = max(1, -(-n_queries // CELL_QUERIES))

    def cells(df: DataFrame, key: str, own: str, own_cells: int, other: str, others: int) -> DataFrame:
        return df.select(
            "*",
            F.pmod(F.xxhash64(key), F.lit(own_cells).cast("bigint")).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))).alias(other),
        )

    left = cells(chunks, "chunk_id", "c_cell", chunk_cells, "q_cell", query_cells)
    right = cells(queries, "query_id", "q_cell", query_cells, "c_cell", chunk_cells)

    def score(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        best = Best(len(q), k)
        if len(c) and len(q):
            _local_topk(best, id_array(pa.array(c["chunk_id"])), _matrix(c["embedding"]), _matrix(q["embedding"]))
        ids_q, ids_c, scores = best.columns(q["query_id"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"query_id": ids_q, "chunk_id": ids_c, "score": scores})

    return (
        left.groupBy("c_cell", "q_cell")
        .cogroup(right.groupBy("c_cell", "q_cell"))
        .applyInPandas(score, result_schema(chunks))
    )


def dense_topk(
    chunks: DataFrame, queries: DataFrame, k: int = 5, max_shipped: int = MAX_SHIPPED_QUERIES
) -> DataFrame:
    """Exact top ``k`` by cosine: ``query_id, chunk_id, score, rank``."""
    require_positive(top_k=k)
    left, right = _sides(chunks, queries)
    local = _shipped(left, right, k) if at_most(right, max_shipped) else _grid(left, right, k)
    return rank_topk(local, k)


@functools.cache
def sign_planes(dimensions: int, bits: int) -> np.ndarray:
    """``dimensions`` x ``bits`` numbers 1 and -1 that any engine can make again.

    The sign at (i, j) is plus when the md5 of the text "i,j" begins with 8 to f.
    """
    digits = [[hashlib.md5(f"{i},{j}".encode()).hexdigest()[0] for j in range(bits)] for i in range(dimensions)]
    return np.where(np.array(digits) >= "8", 1.0, -1.0)


def sketches(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words: on which side of each plane a vector lies."""
    return np.packbits(vectors @ planes > 0, axis=1).view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing signs of each row of ``a`` and each row of ``b``."""
    total = np.zeros((len(a), len(b)), dtype=np.uint16)
    for word in range(a.shape[1]):
        total += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return total


def _near_sketches(
    chunks: DataFrame, queries: DataFrame, bits: int, radius: int, schema: str, collect: Callable, block_rows: int
) -> DataFrame:
    """Candidates of all queries, block by block; ``collect`` makes a task's rows from them.

    A block of queries is shipped at once and has at most ``block_rows`` vectors.
    """
    blocks = 1 if at_most(queries, block_rows) else -(-2 * queries.count() // block_rows)
    parts = []
    for block in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = own.collect()  # bounded by block_rows
        ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        payload = chunks.sparkSession.sparkContext.broadcast((ids, _matrix(r["embedding"] for r in rows)))

        def run(batches: Iterator[pa.RecordBatch], payload=payload) -> Iterator[pa.RecordBatch]:
            ids, matrix = payload.value
            if not len(ids):
                return
            planes = sign_planes(matrix.shape[1], bits)
            own = sketches(matrix, planes)

            def candidates():
                step = max(1, 4_000_000 // len(ids))
                for batch in batches:
                    for start in range(0, batch.num_rows, step):
                        part = batch.slice(start, step)
                        vectors = _arrow_matrix(part.column("embedding"), part.num_rows)
                        near = np.nonzero(differing(own, sketches(vectors, planes)) <= radius)
                        yield id_array(part.column("chunk_id")), vectors, near

            yield from collect(ids, matrix, candidates())

        parts.append(chunks.mapInArrow(run, schema))
    return functools.reduce(DataFrame.unionByName, parts)


def dense_topk_ann(
    chunks: DataFrame, queries: DataFrame, k: int = 5, bits: int = SKETCH_BITS, radius: int = SKETCH_RADIUS,
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """Approximate top ``k``: candidates by binary sketches first, exact scores for them only.

    A sketch holds the sides of ``bits`` fixed planes that a vector lies on, one
    bit each. A chunk is a candidate of a query when at most ``radius`` bits
    differ; no other pair is multiplied. Candidates are scored exactly and cut
    to the best ``k`` inside the task, so pairs are never shuffled.
    """
    require_positive(top_k=k, bits=bits)
    left, right = _sides(chunks, queries)

    def collect(ids, matrix, found):
        best = Best(len(ids), k)
        for chunk_ids, vectors, (q, c) in found:
            scores = np.full((len(ids), len(chunk_ids)), -np.inf)
            for a in range(0, len(q), 200_000):
                i, j = q[a : a + 200_000], c[a : a + 200_000]
                scores[i, j] = np.einsum("ij,ij->i", matrix[i], vectors[j])
            best.add(scores, chunk_ids)
        kept = best.batch(ids)
        if kept is not None:
            yield kept

    return rank_topk(_near_sketches(left, right, bits, radius, result_schema(chunks), collect, max_shipped), k)


def ann_candidates(
    chunks: DataFrame, queries: DataFrame, bits: int = SKETCH_BITS, radius: int = SKETCH_RADIUS, max_shipped: int = MAX_SHIPPED_QUERIES
) -> DataFrame:
    """``query_id, n_scored``: how many chunks the approximate search scores for each query."""
    left, right = _sides(chunks, queries)

    def collect(ids, matrix, found):
        counts = np.zeros(len(ids), dtype=np.int64)
        for _, _, (q, _) in found:
            counts += np.bincount(q, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["query_id", "n"])

    counted = _near_sketches(left, right, bits, radius, "query_id bigint, n bigint", collect, max_shipped)
    return counted.groupBy("query_id").agg(F.sum("n").alias("n_scored"))


def ann_recall(chunks: DataFrame, queries: DataFrame, k: int = 5, bits: int = SKETCH_BITS, radius: int = SKETCH_RADIUS) -> DataFrame:
    """``query_id, n_true, n_found, recall, n_scored``: the approximate lists held against the exact ones."""
    found = dense_topk_ann(chunks, queries, k, bits, radius).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    true = dense_topk(chunks, queries, k).select("query_id", "chunk_id")
    compared = true.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id")
    counts = compared.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.col("n_found") / F.col("n_true")).join(ann_candidates(chunks, queries, bits, radius), "query_id")
