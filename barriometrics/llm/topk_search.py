"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors are whole numbers, floor(scale * x). A task turns its vectors into column-major blocks of
``CHUNK_ROWS``. For a query, partial scores grow by one block of dimensions at a time; what the remaining
dimensions can still add is at most the product of the remaining lengths of query and vector (the mass
left in them), so vectors whose partial score plus that bound stays below the query's k-th best score so
far are dropped and the survivors compacted. Bounds are never below the true score, so results are exact.

Queries are a stated set; they go to the tasks in blocks of at most ``QUERY_BLOCK``, one pass each. Every
task returns its own k best of each query, and the final ranking is taken in two steps, by task groups
and then over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from barriometrics.session import materialise

K = 10
SCALE = 1024
QUERY_BLOCK = 4096
CHUNK_ROWS = 4096
DIMENSIONS = 16
GROUPS = 64
#: Up to here sums of products of whole numbers are exact in double precision.
EXACT = 2.0**53


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; vectors that are NULL or hold NULL, NaN or infinity are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & finite)
    floored = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    huge = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.select("id", F.when(F.forall("v", lambda x: F.abs(x * scale) < 2.0**53), floored).otherwise(huge).alias("v"))


def _matrices(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by number of components: ids and a column-major matrix (components, rows)."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    ids = ids.to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = (ids[rows], np.ascontiguousarray(flat[starts[rows][:, None] + np.arange(d)].T))
    return out


class Best:
    """The k best (score, id) of every query of a block, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries

    def floor(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        if len(scores) > 4 * self.k:  # only those not below the k-th can stay
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= kth
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def search_chunk(best: Best, numbers: np.ndarray, own: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, exact: bool) -> None:
    """Branch-and-bound of the queries (rows) over one column-major chunk."""
    d = len(columns)
    cuts = list(range(0, d, DIMENSIONS)) or [0]
    left = np.zeros((len(cuts) + 1, columns.shape[1]))
    q_left = np.zeros((len(cuts) + 1, len(queries)))
    for b in range(len(cuts) - 1, -1, -1):
        part = slice(cuts[b], cuts[b] + DIMENSIONS)
        left[b] = left[b + 1] + (columns[part].astype(np.float64) ** 2).sum(0)
        q_left[b] = q_left[b + 1] + (queries[:, part].astype(np.float64) ** 2).sum(1)
    left, q_left = np.sqrt(left) * (1 + 1e-9), np.sqrt(q_left) * (1 + 1e-9)
    for q, number in enumerate(numbers):
        alive = np.flatnonzero(ids != own[q])
        total = np.zeros(len(alive)) if exact else np.zeros(len(alive), object)
        floor = best.floor(number)
        for b, cut in enumerate(cuts):
            if not len(alive):
                break
            part = slice(cut, cut + DIMENSIONS)
            block = columns[part] if len(alive) == columns.shape[1] else columns[part][:, alive]
            total = total + (queries[q, part] @ block if exact else _long_products(queries[q, part], block))
            if floor > -np.inf:
                keep = total.astype(np.float64) + q_left[b + 1, q] * left[b + 1, alive] >= floor - (0 if exact else abs(floor) * 1e-9)
                alive, total = alive[keep], total[keep]
        if len(alive):
            best.add(number, np.asarray(total, np.float64) if exact else np.array([_clip(t) for t in total], np.float64), ids[alive])


def _clip(value: int) -> int:
    return max(-(2**63), min(2**63 - 1, int(value)))


def _long_products(query: np.ndarray, block: np.ndarray) -> np.ndarray:
    total = np.zeros(block.shape[1], object)
    for x, row in zip(query.tolist(), block, strict=True):
        total += int(x) * np.array([int(y) for y in row.tolist()], object)
    return total


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other rows of ``vectors`` (id, v).

    ``is_query`` chooses queries by ``id``. Only vectors of as many components are scored. Ties go to the
    smaller id, rank from 1. Rows with the query's id are its own; rows that repeat another id are each
    candidates. A query repeated whole counts once. Rows without id take no part. Sums beyond 2**53 are
    taken in whole numbers, then ordered and given as doubles, and held within a long.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("id IS NOT NULL")
    queries = materialise(vectors.where(is_query).distinct(), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(rows.to_batches())

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for rows in shared.value:
                for d, (ids, columns) in _matrices(rows.column("id"), rows.column("v")).items():
                    old = asked.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                    asked[d] = (np.concatenate((old[0], ids)), np.concatenate((old[1], columns.T)))
            best = {d: Best(len(ids), k) for d, (ids, _) in asked.items()}
            for batch in batches:
                for d, (ids, columns) in _matrices(batch.column("id"), batch.column("v")).items():
                    if d not in asked:
                        continue
                    own, wanted = asked[d]
                    exact = d * max(1.0, np.abs(wanted).max(initial=0)) * max(1.0, np.abs(columns).max(initial=0)) < EXACT
                    for a in range(0, len(ids), CHUNK_ROWS):
                        part = np.ascontiguousarray(columns[:, a : a + CHUNK_ROWS])
                        search_chunk(best[d], np.arange(len(own)), own, wanted, ids[a : a + CHUNK_ROWS], part, exact)
            group = TaskContext.get().partitionId() % GROUPS
            for d, (own, _) in asked.items():
                sizes = [len(s) for s in best[d].scores]
                scores = np.concatenate(best[d].scores) if sizes else np.zeros(0)
                scores = np.array([_clip(s) for s in scores], np.int64) if np.abs(scores).max(initial=0) >= EXACT else scores.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, sizes)), pa.array(np.concatenate(best[d].ids) if sizes else np.zeros(0, np.int64)), pa.array(scores), pa.array(np.full(len(scores), group, np.int32)), pa.array(np.full(len(scores), d, np.int32))],
                    ["query_id", "vec_id", "score", "part", "d"],
                )

        part = vectors.mapInArrow(search, "query_id long, vec_id long, score long, part int, d int")
        found = part if found is None else found.unionByName(part)
    order = (F.desc("score"), F.asc("vec_id"))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The k best of every vector whose vec_id is divisible by ``every``."""
    return top_k(whole_vectors(vectors), F.col("id") % every == 0, k)
