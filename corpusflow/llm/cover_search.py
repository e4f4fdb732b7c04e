"""Exact best-k inner products by dual-tree search over cover trees.

Queries travel in blocks of bounded size; every task indexes its vectors in
cover trees of bounded size and walks each against the tree of the query block.
A pair of nodes is skipped when the largest product that the covering radii
allow is below the worst k-th score of the queries in the query node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
QUERY_BLOCK = 8_192
TREE_ROWS = 8_192
LEAF = 48
QUERY_LEAF = 8  # small groups of queries have a worst score worth pruning by
# A node whose points need more balls of half its radius than this is a leaf:
# nothing nearer than brute force is to be had there.
BALLS = 96
EXACT = float(1 << 53)


def whole_vectors(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> (ids, floor(SCALE * x)); vectors that are null, empty or not finite, and null ids, are left out."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.array(pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    known = np.array(pa.compute.is_valid(ids).to_numpy(zero_copy_only=False), dtype=bool)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for size in np.unique(sizes[(sizes > 0) & known]).tolist():
        rows = np.flatnonzero((sizes == size) & known)
        values = flat[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(values).all(axis=1)
        if fine.any():
            out[size] = (numbers[rows[fine]], np.floor(SCALE * values[fine]))
    return out


class CoverTree:
    """Centres, covering radii, children; built from the root down, each level at half the radius."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.center: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.grow(np.arange(len(points)), 0)

    def grow(self, rows: np.ndarray, center: int) -> int:
        points = self.points[rows]
        middle = points[center]
        away = np.sqrt(((points - middle) ** 2).sum(axis=1))
        radius = float(away.max())
        node = len(self.center)
        self.center.append(middle)
        self.norm.append(float(np.sqrt((middle**2).sum())))
        self.radius.append(radius)
        self.children.append([])
        self.members.append(rows)
        if len(rows) <= self.leaf or radius == 0:
            return node
        # Balls of half the radius; a new centre lies outside all earlier balls.
        left = np.arange(len(rows))
        balls, next_center = [], center
        while len(left):
            if len(balls) == BALLS:
                return node
            apart = np.sqrt(((points[left] - points[next_center]) ** 2).sum(axis=1))
            inside = apart <= radius / 2
            inside[left == next_center] = True
            balls.append((left[inside], next_center))
            left, apart = left[~inside], apart[~inside]
            if len(left):
                next_center = int(left[apart.argmax()])
        for own, own_center in balls:
            self.children[node].append(self.grow(rows[own], int(np.flatnonzero(own == own_center)[0])))
        return node


class Best:
    """The best ``k`` of every query so far: higher scores first, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        useful = (scores >= self.scores[rows, -1][:, None]).any(axis=0)
        if not useful.any():
            return
        scores, ids = scores[:, useful], ids[useful]
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        wide = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((wide, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(wide, order, axis=1)


class Search:
    """One block of queries of one dimension, searched in tree after tree."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.tree = CoverTree(queries, QUERY_LEAF)
        self.best = Best(len(query_ids), k)
        self.compared = 0  # pairs of vectors whose product was taken

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
            return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)
        return a @ b.T

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        """Search all of ``points``; of equal vectors only the smallest ids can count."""
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        same = np.unique(points, axis=0, return_inverse=True)[1].ravel()
        by = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]]))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        rows = np.sort(by[place <= self.k])  # one more than k, as one may be the query itself
        for a in range(0, len(rows), TREE_ROWS):
            some = rows[a : a + TREE_ROWS]
            self.walk(CoverTree(points[some]), ids[some], 0, 0)

    def walk(self, data: CoverTree, ids: np.ndarray, root_q: int, root_d: int) -> None:
        mine = self.tree
        stack = [(root_q, root_d)]
        while stack:
            q, d = stack.pop()
            middle = float(mine.center[q] @ data.center[d])
            most = middle + mine.radius[q] * data.norm[d] + data.radius[d] * mine.norm[q] + mine.radius[q] * data.radius[d]
            worst = self.best.scores[mine.members[q], -1].min()
            if most * (1 + 1e-12) + 1e-6 < worst:
                continue
            kids_q, kids_d = mine.children[q], data.children[d]
            if not kids_q and not kids_d:
                self.compare(mine.members[q], data.points[data.members[d]], ids[data.members[d]])
            elif kids_d and (not kids_q or data.radius[d] >= mine.radius[q]):
                near = np.array([mine.center[q] @ data.center[c] for c in kids_d])
                stack += [(q, kids_d[i]) for i in np.argsort(near, kind="stable")]  # the nearest is looked at first
            else:
                stack += [(c, d) for c in kids_q]

    def compare(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray) -> None:
        scores = self.products(self.tree.points[rows], points)
        self.compared += scores.size
        scores[self.query_ids[rows][:, None] == ids[None, :]] = -np.inf
        self.best.add(rows, scores, ids)


def top_products(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, embedding).

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows of another id and the same dimension. Components are floor(1024 x);
    vectors that are null, empty, or hold null or non-finite components, and
    rows of null ids, take no part. Equal scores go by the smaller id. Repeated
    rows are candidates each, and one query together; vectors that share a
    query's id have their candidates ranked together. Fewer candidates than
    ``k`` give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = given.where(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = None
    for block in range(blocks):
        # One block of queries at a time passes through the driver, about ``query_block`` vectors.
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        queries = whole_vectors(rows["vec_id"].combine_chunks(), rows["embedding"].combine_chunks()) if rows.num_rows else {}
        shipped = spark.sparkContext.broadcast(queries)
        part = given.mapInArrow(_searcher(shipped, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(shipped, k: int):
    def run(batches):
        searches = {}
        for size, (ids, points) in shipped.value.items():
            once = list({(i, p.tobytes()): row for row, (i, p) in enumerate(zip(ids.tolist(), points))}.values())
            searches[size] = Search(ids[once], points[once], k)
        held: dict[int, list] = {size: [] for size in searches}

        def flush(size: int) -> None:
            ids, points = (np.concatenate(x) for x in zip(*held[size]))
            held[size] = []
            searches[size].add(ids, points)

        for batch in batches:
            for size, found in whole_vectors(batch.column(0), batch.column(1)).items():
                if size in searches:
                    held[size].append(found)
                    if sum(len(ids) for ids, _ in held[size]) >= 4 * TREE_ROWS:
                        flush(size)
        for size, search in searches.items():
            if held[size]:
                flush(size)
            some = np.isfinite(search.best.scores)
            query = np.broadcast_to(search.query_ids[:, None], some.shape)[some]
            columns = [query, search.best.ids[some], search.best.scores[some].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run
