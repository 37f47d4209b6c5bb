"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to the rows and columns of a grid of blocks by hash; each goes to all blocks of its row or column, and every pair
meets in one block. There the queries are read first and the candidates stream past them in tiles. Both are quantised to int8 with a
scale of their own, and one matrix product of a tile gives all distances with an error bound: by the triangle inequality a distance is
off by no more than the two quantisation errors. Only pairs that may still be among a query's nearest are computed again, from the original
numbers in double precision, and kept in a heap for each query. Spark merges the heaps of all blocks. Nothing passes through the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import stored

#: Queries of a block, about; queries and candidates of a tile.
BLOCK_QUERIES = 16384
TILE_QUERIES = 512
TILE_ROWS = 4096
#: Components that one float32 product sums exactly: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024


class Quantised:
    """int8 codes of vectors (rows), their scales, and how far each code is from its vector at most."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(1) / 127
        self.code = np.rint(x / self.scale[:, None]).astype(np.int8)
        back = self.code * self.scale[:, None]
        size = np.abs(x).max(1) * x.shape[1]
        # a margin for the rounding of the sums in double precision
        self.error = np.sqrt(((x - back) ** 2).sum(1)) + 1e-12 * size
        self.norm2 = (self.code.astype(np.float64) ** 2).sum(1) * self.scale**2

    def part(self, rows: slice) -> Quantised:
        out = object.__new__(Quantised)
        out.scale, out.code, out.error, out.norm2 = self.scale[rows], self.code[rows], self.error[rows], self.norm2[rows]
        return out


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the distances of each query to each candidate."""
    product = np.zeros((len(q.code), len(c.code)))
    for d in range(0, q.code.shape[1], EXACT):
        product += q.code[:, d : d + EXACT].astype(np.float32) @ c.code[:, d : d + EXACT].astype(np.float32).T
    square = q.norm2[:, None] + c.norm2[None, :] - 2 * q.scale[:, None] * c.scale[None, :] * product
    # 1e-6 of the norms: what cancellation may cost the square root
    slack = 1e-7 * (np.sqrt(q.norm2)[:, None] + np.sqrt(c.norm2)[None, :]) + q.error[:, None] + c.error[None, :]
    about = np.sqrt(np.maximum(square, 0))
    return about - slack, about + slack


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision, summed in order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += (a[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


class Heaps:
    """The k nearest candidates of each query so far, the farthest on top."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.q = ids, x, k, Quantised(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        c = Quantised(x)
        for a in range(0, len(self.ids), TILE_QUERIES):
            rows = slice(a, a + TILE_QUERIES)
            lower, upper = bounds(self.q.part(rows), c)
            own = self.ids[rows, None] == ids[None, :]
            lower[own] = upper[own] = np.inf
            limit = self.worst[rows]
            if len(ids) >= self.k:
                limit = np.minimum(limit, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(~(lower > limit[:, None]) & ~own)  # a bound that overflowed rules nothing out
            if not len(i):
                continue
            exact = distance(self.x[a + i], x[j])
            for q, d, v in zip((a + i).tolist(), exact.tolist(), ids[j].tolist(), strict=True):
                h = self.heaps[q]
                if len(h) < self.k:
                    heapq.heappush(h, (-d, -v))
                elif (-d, -v) > h[0]:
                    heapq.heapreplace(h, (-d, -v))
            for q in np.unique(a + i).tolist():
                if len(self.heaps[q]) == self.k:
                    self.worst[q] = -self.heaps[q][0][0]

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for q, h in zip(self.ids.tolist(), self.heaps, strict=True):
            for d, v in h:
                yield q, -v, -d


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of the vectors of each dimension, in double precision."""
    ids, sizes = ids.to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], flat[(ends[rows] - n)[:, None] + np.arange(n)]


def grid(n_queries: int, n_rows: int) -> tuple[int, int]:
    """Rows of the grid, over queries, and columns, over candidates: as many columns as keep a tile busy, but no more than make queries move as much as candidates."""
    down = max(1, math.ceil(n_queries / BLOCK_QUERIES))
    return down, max(1, min(math.ceil(n_rows / TILE_ROWS), math.ceil(n_rows * down / max(1, n_queries))))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest other rows by Euclidean distance, ties to the smaller vec_id.

    Exact: the int8 product only discards pairs that its error bound rules out. Vectors are compared with those of their own
    dimension. Rows without vec_id and vectors that are null, empty, zero or not finite take no part. Of rows that repeat a query's vec_id the
    least vector is the query; a candidate with the query's vec_id is the query's own row; other repeated rows are candidates each. With fewer
    candidates than k, all are returned; no rows or no queries give none. Other columns play no part.
    """
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q"))
    queries = stored(rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v")), "nearest_queries")
    down, across = grid(queries.count(), rows.count())
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(dealt(down).alias("i"), spread(across).alias("j"), F.lit(False).alias("later"), "vec_id", "v")
    seen = rows.select(spread(down).alias("i"), dealt(across).alias("j"), F.lit(True).alias("later"), "vec_id", "v")
    blocks = asked.union(seen).repartition(down * across, "i", "j").sortWithinPartitions("i", "j", "later")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, heaps = None, {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def found() -> pa.RecordBatch:
            every = [x for h in heaps.values() for x in h.rows()]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in every], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for b in batches:
            place = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j", "later")])
            edges = np.flatnonzero(np.any(place[:, 1:] != place[:, :-1], 0)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                i, j, later = place[:, start].tolist()
                if (i, j) != here:
                    yield found()
                    here, heaps, waiting = (i, j), {}, {}
                own = b.slice(start, stop - start)
                if later and waiting:
                    heaps = {n: Heaps(*(np.concatenate(x) for x in zip(*parts, strict=True)), k) for n, parts in waiting.items()}
                    waiting = {}
                for ids, x in matrices(own.column("vec_id"), own.column("v")):
                    if not later:
                        waiting.setdefault(x.shape[1], []).append((ids, x))
                    elif x.shape[1] in heaps:
                        for a in range(0, len(ids), TILE_ROWS):
                            heaps[x.shape[1]].see(ids[a : a + TILE_ROWS], x[a : a + TILE_ROWS])
        yield found()

    near = blocks.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
