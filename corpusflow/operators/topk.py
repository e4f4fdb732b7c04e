"""Best-k lists kept inside one task, so that scored pairs are never shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Scores are ranked at this many decimals, so that the order in which partial
# sums arrive cannot swap two chunks; ties go to the smaller chunk id.
RANK_DIGITS = 9


def id_array(values: pa.Array) -> np.ndarray:
    """Chunk ids as a sortable numpy array, numbers or text."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False)
    return np.array(values.to_pylist(), dtype=str)


def result_schema(chunks: DataFrame) -> str:
    return f"query_id bigint, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"


class Best:
    """Best ``k`` (score, chunk) pairs per query over the batches of one task."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.n, self.k = n_queries, k
        self.scores = np.full((n_queries, 0), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is queries x chunks; -inf marks a pair that does not count."""
        scores = np.round(scores, RANK_DIGITS)
        if scores.shape[1] > self.k:
            # A column below the k-th best of every query is dropped unsorted;
            # everything at the k-th score stays, so ties are settled by id.
            edge = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            wanted = (scores >= edge[:, None]) & np.isfinite(scores)
            column = wanted.any(axis=0)
            scores, ids = np.where(wanted, scores, -np.inf)[:, column], ids[column]
        wide = np.broadcast_to(ids, (self.n, len(ids)))
        scores = np.concatenate([self.scores, scores], axis=1)
        wide = wide if self.ids is None else np.concatenate([self.ids, wide], axis=1)
        if scores.shape[1] > self.k:
            order = np.lexsort((wide, -scores), axis=1)[:, : self.k]
            scores = np.take_along_axis(scores, order, axis=1)
            wide = np.take_along_axis(wide, order, axis=1)
        self.scores, self.ids = scores, wide

    def columns(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.isfinite(self.scores)
        ids = np.zeros((self.n, 0), dtype=np.int64) if self.ids is None else self.ids
        return np.repeat(query_ids, self.scores.shape[1])[found.ravel()], ids[found], self.scores[found]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch | None:
        """The kept pairs as one Arrow batch, None when nothing was kept."""
        query, chunk, score = self.columns(query_ids)
        if len(query) == 0:
            return None
        chunk_ids = pa.array(chunk.tolist()) if chunk.dtype.kind == "U" else pa.array(chunk, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), chunk_ids, pa.array(score, pa.float64())],
            ["query_id", "chunk_id", "score"],
        )
