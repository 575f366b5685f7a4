"""NumPy helpers of the vector operators: matrices from Arrow lists, distances, and a running top k of a task's batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of double precision differences that exact distances take at once; queries and rows that are compared at once.
_AT_ONCE, _QUERIES, _ROWS = 16 << 20, 512, 4096


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column without nulls, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them."""
    found = column.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def gaps(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all queries to all rows by a matrix product, and for each query how far they may be off by rounding."""
    dots, qq, xx = q @ x.T, (q * q).sum(1), (x * x).sum(1)
    most = xx.max(initial=0.0)
    if metric == "l2":
        dots *= -2
        dots += qq[:, None]
        dots += xx
        return dots, 1e-12 * (qq + most)
    if metric == "dot":
        return -dots, 1e-12 * np.sqrt(qq * most)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - dots / np.sqrt(qq[:, None] * xx), np.full(len(q), 1e-12)
    raise ValueError(f"unknown metric {metric!r}")


def exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, summed in the order of the elements: the same bits as ``functions.text.distance``."""
    product = lambda a, b: np.cumsum(a * b, axis=-1)[..., -1]
    if metric == "l2":
        return product(x - q, x - q)
    if metric == "dot":
        return -product(x, q)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - product(x, q) / np.sqrt(product(x, x) * product(q, q))


def _fewest_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k nearest of anything: of equal vectors the k with the smallest ids."""
    if len(ids) <= k:
        return np.arange(len(ids))
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    starts = np.flatnonzero(np.diff(which[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return np.sort(order[place < k])


class Nearest:
    """The k nearest rows of some queries, by (distance, id), over any number of batches; memory is queries times k, and one tile of distances."""

    def __init__(self, q: np.ndarray, k: int, metric: str = "l2"):
        self.q, self.k, self.metric = q, k, metric
        self.gap = np.full((len(q), k), np.inf)
        self.ids: np.ndarray | None = None
        self.used = np.zeros((len(q), k), bool)

    def add(self, ids: np.ndarray, x: np.ndarray, of: np.ndarray | None = None) -> None:
        """of: the queries that these rows are for; all if none are given."""
        of = np.arange(len(self.q)) if of is None else of
        if not len(ids) or not len(of) or not self.k:
            return
        few = _fewest_copies(ids, x, self.k)
        ids, x = ids[few], x[few]
        step = _QUERIES * max(1, _ROWS // len(ids))  # few rows take more queries at once
        for a in range(0, len(of), step):
            for b in range(0, len(ids), _ROWS):
                self._tile(ids[b : b + _ROWS], x[b : b + _ROWS], of[a : a + step])

    def _tile(self, ids: np.ndarray, x: np.ndarray, of: np.ndarray) -> None:
        gap, off = gaps(self.q[of], x, self.metric)
        width = min(len(ids), 2 * self.k + 8)
        near = np.argpartition(gap, width - 1, axis=1)[:, :width]
        close = np.sort(np.take_along_axis(gap, near, 1), axis=1)
        kth = close[:, min(self.k, width) - 1]
        # A query whose rows near the k-th distance may not all be among those taken is looked at by itself.
        unsure = (close[:, -1] <= kth + 2 * off) & (width < len(ids))
        step = max(1, _AT_ONCE // (width * x.shape[1] * 8))
        sure = np.flatnonzero(~unsure)
        for a in range(0, len(sure), step):
            part = sure[a : a + step]
            self._merge(of[part], ids[near[part]], exact(self.q[of[part]][:, None, :], x[near[part]], self.metric))
        for j in np.flatnonzero(unsure):
            taken = np.flatnonzero(gap[j] <= kth[j] + 2 * off[j])
            true = np.concatenate([exact(self.q[of[j]], x[taken[a : a + 65536]], self.metric) for a in range(0, len(taken), 65536)])
            best = np.lexsort((ids[taken], true))[: self.k]
            self._merge(of[j : j + 1], ids[taken[best]][None], true[best][None])

    def _merge(self, of: np.ndarray, ids: np.ndarray, gap: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.zeros(self.gap.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        all_gaps = np.concatenate([self.gap[of], gap], axis=1)
        all_ids = np.concatenate([self.ids[of], ids], axis=1)
        used = np.concatenate([self.used[of], ~np.isnan(gap)], axis=1)
        order = np.lexsort((all_ids, np.where(used, all_gaps, np.inf), ~used), axis=1)[:, : self.k]
        self.gap[of], self.ids[of], self.used[of] = (np.take_along_axis(v, order, 1) for v in (all_gaps, all_ids, used))

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query places, ids, distances), some queries at a time."""
        for a in range(0, len(self.q) if self.ids is not None else 0, _ROWS):
            at, place = np.nonzero(self.used[a : a + _ROWS])
            yield at + a, self.ids[at + a, place], self.gap[at + a, place]


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k centres of the rows; distinct rows if there are no more than k. Empty centres move to the rows that lie farthest."""
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        gap = gaps(x, centres, "l2")[0]
        near = gap.argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres = sums / np.maximum(counts, 1)[:, None]
        if len(empty := np.flatnonzero(counts == 0)):
            centres[empty] = x[np.argsort(gap[np.arange(len(x)), near])[-len(empty) :]]
    return centres
