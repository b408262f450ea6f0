"""The k largest cosines between query vectors and candidates, as products of tiles.

A task holds one block of query vectors and takes the candidates tile by tile.
Products of unit vectors lie within a known error of the score, so that only
pairs that may still be among a query's best are scored component by component
in double precision. Each query keeps its k best by rounded score and id.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and candidates of a tile.
QUERY_TILE, TILE = 512, 2048
#: The id of a place that no candidate has yet; its score is 0, which a candidate has to exceed.
NONE = np.iinfo(np.int64).min


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up by the decimal notation, as Spark's round."""
    unit = 10.0**digits
    shifted = np.abs(x) * unit
    out = np.copysign(np.floor(shifted + 0.5) / unit, x)
    for i in np.flatnonzero(np.abs(shifted - np.floor(shifted) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def by_size(ids: pa.Array, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors (double) by number of components, without null ids and vectors that are null, empty or hold nulls."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    good = (sizes > 0) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
    if pc.list_flatten(lists).null_count:
        good[np.unique(pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[pc.is_null(pc.list_flatten(lists)).to_numpy(zero_copy_only=False)])] = False
    out = {}
    for size in np.unique(sizes[good]).tolist():
        pick = pa.array(np.flatnonzero(good & (sizes == size)))
        out[size] = ids.take(pick).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists.take(pick)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return out


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors times a power of two each, which no cosine depends on; their norms; unit vectors, NaN where there are none)."""
    with np.errstate(all="ignore"):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        total = np.zeros(len(x))
        for i in range(x.shape[1]):
            total += x[:, i] * x[:, i]
        norm = np.sqrt(total)
        return x, norm, x / norm[:, None]


class Best:
    """The k best candidates so far of each query of a block; a score that is not a number comes first, as in SQL."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, digits: int):
        self.ids, self.k, self.digits = ids, k, digits
        self.x, self.norm, self.unit = scaled(x)
        self.score, self.order = np.zeros((len(ids), k)), np.zeros((len(ids), k))
        self.of = np.full((len(ids), k), NONE)
        self.half, self.slack = 0.5 * 10.0**-digits, 1e-12 + 4e-16 * (x.shape[1] + 8)

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        y, norm, unit = scaled(y)
        own = np.flatnonzero(np.isin(ids, self.ids))
        for at in range(0, len(self.ids), QUERY_TILE):
            part = slice(at, at + QUERY_TILE)
            self._add(at, part, ids, y, norm, self.unit[part] @ unit.T, own)

    def _add(self, at: int, part: slice, ids, y, norm, near: np.ndarray, own: np.ndarray) -> None:
        if len(own):
            near[:, own] = np.where(self.ids[part, None] == ids[None, own], -np.inf, near[:, own])
        last, last_id = self.order[part, -1], self.of[part, -1]
        low = last - self.half - self.slack
        may = ~(near < low[:, None])
        if near.shape[1] > self.k and np.count_nonzero(may) > 4 * self.k * len(near):
            kth = np.partition(near, -self.k, axis=1)[:, -self.k]
            may = ~(near < np.fmax(low, kth - 2 * (self.half + self.slack))[:, None])
        i, j = np.nonzero(may)
        p = near[i, j]
        # Ties with the last place need a smaller id.
        better = (p >= (last + self.half - self.slack)[i]) | (np.isnan(p) & np.isfinite(last[i])) | (ids[j] < last_id[i])
        keep = better & (p != -np.inf)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        total, x = np.zeros(len(i)), self.x[part]
        with np.errstate(all="ignore"):
            for c in range(y.shape[1]):
                total += x[i, c] * y[j, c]
            score = total / norm[j] / self.norm[part][i]
        order = np.where(np.isnan(score), np.inf, rounded(np.nan_to_num(score), self.digits))
        self._merge(i + at, ids[j], score, order)

    def _merge(self, i: np.ndarray, of: np.ndarray, score: np.ndarray, order: np.ndarray) -> None:
        rows = np.unique(i)
        held = np.repeat(rows, self.k)
        i, of, score, order = np.concatenate([held, i]), np.concatenate([self.of[rows].ravel(), of]), np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.order[rows].ravel(), order])
        by = np.lexsort((of, -order, i))
        i = i[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = by[place < self.k]  # k of each row, as so many are held
        self.of[rows], self.score[rows], self.order[rows] = of[top].reshape(-1, self.k), score[top].reshape(-1, self.k), order[top].reshape(-1, self.k)

    def rows(self):
        i, j = np.nonzero(self.of != NONE)
        return self.ids[i], self.of[i, j], self.score[i, j]


def search(block, k: int, digits: int):
    """For mapInArrow over (id, vector): query_id, id, score: the k best of the task's candidates for each query of the block."""

    def run(batches):
        best = {size: Best(ids, x, k, digits) for size, (ids, x) in block.value.items()}
        for batch in batches:
            for size, (ids, y) in by_size(batch.column(0), batch.column(1)).items():
                if size in best:
                    for at in range(0, len(ids), TILE):
                        best[size].add(ids[at : at + TILE], y[at : at + TILE])
        for b in best.values():
            q, of, score = b.rows()
            for at in range(0, len(q), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(q[part], pa.int64()), pa.array(of[part], pa.int64()), pa.array(score[part], pa.float64())], names=["query_id", "id", "score"])

    return run
