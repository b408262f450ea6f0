"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries are taken in blocks of bounded size; each block is broadcast and meets
every tile of candidates. Vectors are quantised to whole numbers of at most
127 with a scale each. The product of two tiles of such numbers is exact in
float32 (slice by slice), and the norms of the quantisation residues bound its
distance from the true inner product. Pairs whose least possible distance
exceeds the query's best k greatest possible distances are out; the others are
recomputed in double precision, and each query keeps a heap of its k nearest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage, table
from docloom.ship import ship

#: Bytes of original query vectors that are broadcast at once; bounds the broadcast.
BLOCK_BYTES = 16 << 20
#: Queries and candidates of a product tile.
QUERY_TILE, TILE = 512, 2048
#: 127 * 127 * SLICE stays below 2**24, so float32 sums of int8 products are exact.
SLICE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 matrix, scales, norms of the quantised vectors, norms of the residues, squared norms) of the rows of x (double)."""
    scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    with np.errstate(over="ignore"):
        return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1), (x * x).sum(1)


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two int8 matrices."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLICE):
        out += a[:, at : at + SLICE].astype(np.float32) @ b[:, at : at + SLICE].astype(np.float32).T
    return out


def bounds(p, q) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible squared distances between two quantised blocks.

    Where the numbers are too large for a bound, it is minus or plus infinity, so that the pair survives.
    """
    with np.errstate(all="ignore"):
        return _bounds(p, q)


def _bounds(p, q) -> tuple[np.ndarray, np.ndarray]:
    dot = tile_products(p[0], q[0]) * p[1][:, None] * q[1][None, :]
    # <x, y> = <x', y'> + <x - x', y'> + <x, y - y'>, and |x| <= |x'| + |x - x'|.
    slack = p[3][:, None] * q[2][None, :] + (p[2] + p[3])[:, None] * q[3][None, :]
    middle = p[4][:, None] + q[4][None, :] - 2 * dot
    slack = 2 * slack + 1e-9 * (p[4][:, None] + q[4][None, :])  # and rounding in double precision
    known = np.isfinite(middle) & np.isfinite(slack)
    return np.where(known, middle - slack, -np.inf), np.where(known, middle + slack, np.inf)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, summed in order of the components."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for i in range(x.shape[1]):
            d = x[:, i] - y[:, i]
            total += d * d
    return np.sqrt(total)


class Nearest:
    """The k nearest candidates so far of each query of a block, as heaps of (-distance, -id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.quantised = quantise(x)
        self.heaps: list[list] = [[] for _ in ids]
        self.limit = np.full(len(ids), np.inf)  # squared distance that a pair must not exceed

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        q = quantise(y)
        for at in range(0, len(self.ids), QUERY_TILE):
            part = slice(at, at + QUERY_TILE)
            low, high = bounds([m[part] for m in self.quantised], q)
            same = self.ids[part, None] == ids[None, :]
            low[same] = high[same] = np.inf
            limit = self.limit[part]
            if high.shape[1] >= self.k:
                limit = np.minimum(limit, np.partition(high, self.k - 1, 1)[:, self.k - 1])
            i, j = np.nonzero((low <= limit[:, None]) & ~same)
            d = distances(self.x[part][i], y[j])
            for a, b, distance in zip(i + at, j, d.tolist(), strict=True):
                heap, item = self.heaps[a], (-distance, -int(ids[b]))
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            for a in set((i + at).tolist()):
                if len(self.heaps[a]) == self.k:
                    d = -self.heaps[a][0][0]
                    self.limit[a] = d * d * (1 + 1e-12) + 1e-300


def _search(block, k: int):
    def run(batches):
        ids, x = block.value
        nearest: dict[int, Nearest] = {}
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(x):
            by_size.setdefault(len(v), []).append(i)
        for size, rows in by_size.items():
            nearest[size] = Nearest(np.array([ids[i] for i in rows], np.int64), np.array([x[i] for i in rows], float), k)
        for batch in batches:
            lists = batch.column(1)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            vec_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for size in by_size:
                pick = np.flatnonzero(sizes == size)
                if not len(pick):
                    continue
                y = lists.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                for at in range(0, len(pick), TILE):
                    nearest[size].add(vec_ids[pick[at : at + TILE]], y[at : at + TILE])
        for n in nearest.values():
            found = [(int(q), -i, -d) for q, heap in zip(n.ids, n.heaps, strict=True) for d, i in heap]
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + 50_000], strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: without vectors that are null, zero or hold null or non-finite components."""
    v = F.transform(vectors[vector], lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest candidates of each query, never the query's own id.

    queries and candidates have vec_id and v (array<double>), as usable() gives
    them. score is the Euclidean distance in double precision; ties go to the
    smaller vec_id. Only vectors of the query's length are compared. A query
    with fewer candidates gets all of them; one without any gets no rows, and
    so do empty tables. Rows that repeat a vec_id are candidates each, but of
    repeated query ids one, with the smallest vector, is searched.
    """
    spark = ship(queries.sparkSession)
    ordered, _ = stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    total = ordered.agg(F.sum(F.size("v") * 8 + 64), F.count(F.lit(1))).first()
    blocks = max(1, -(-(total[0] or 0) // block_bytes))
    dealt = ordered.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    done = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for b in range(blocks):
        # About block_bytes, whatever the number of queries. One block at a time is held by the driver and the tasks.
        rows = dealt.where(F.col("block") == b).select("vec_id", "v").toPandas()
        if not len(rows):
            continue
        block = spark.sparkContext.broadcast((rows["vec_id"].tolist(), [np.asarray(v, float) for v in rows["v"]]))
        found, _ = stage(_ranked(candidates.select("vec_id", "v").mapInArrow(_search(block, k), "query_id long, vec_id long, score double"), k), "nearest")
        block.destroy()
        done = done.union(found)
    return done


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what tasks have sent, k rows a query each at most. They meet in two steps, so that no task gets those of all."""
    salted = Window.partitionBy("query_id", "salt").orderBy("score", "vec_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    some = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k)
    return some.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """nearest() over embeddings: vectors with an id divisible by 100 against all others. Unusable vectors take no part; the other edge cases are nearest()'s."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
         sqrt(list_sum(list_transform(range(len(q.x)), lambda i: (q.x[i + 1] - c.x[i + 1]) * (q.x[i + 1] - c.x[i + 1])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
