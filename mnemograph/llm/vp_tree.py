"""A vantage-point tree over unit vectors, searched by many queries at once."""

from __future__ import annotations

import numpy as np

LEAF = 512


def distances(dots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors from their dot products."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def _apart(nearer: np.ndarray, farther: np.ndarray) -> np.ndarray:
    """Least distance of two unit vectors at these distances from a third one: by the triangle
    inequality, or, where that is more, as the difference of their projections on it."""
    return (farther - nearer) * np.maximum(1.0, (farther + nearer) / 2)


class VPTree:
    """Nodes are (vantage, largest inner distance, least outer distance, inner, outer) or leaves (begin, end).

    Points are addressed by their row in ``vectors``, which may have any length; rows are
    expected in the order of their ids, so that of equally distant points the one with the
    smaller row is taken. Products are screened in single precision, with room for its
    error, and what may be near is computed in double precision.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.vectors = vectors
        self.norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64))
        self.rng = np.random.default_rng(seed)
        vantages: list[np.ndarray] = []
        leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(vectors)), vantages, leaves)
        self.vantages = np.array(vantages).reshape(-1, vectors.shape[1])
        #: the rows leaf by leaf, so that a leaf is one piece of ``short``
        self.order = np.concatenate(leaves)
        self.short = self._unit(self.order).astype(np.float32)

    def _unit(self, rows) -> np.ndarray:
        return self.vectors[rows] / self.norms[rows, None]

    def _build(self, rows: np.ndarray, vantages: list[np.ndarray], leaves: list[np.ndarray]):
        if len(rows) <= LEAF:
            begin = sum(map(len, leaves))
            leaves.append(rows)
            return begin, begin + len(rows)
        # of a few candidates the one that spreads a sample most
        some = rows[self.rng.integers(0, len(rows), 64)]
        trial = rows[self.rng.integers(0, len(rows), 6)]
        spread = distances(self._unit(trial) @ self._unit(some).T).std(axis=1)
        vantage = self._unit([trial[np.argmax(spread)]])[0]
        at = len(vantages)
        vantages.append(vantage)
        d = distances(self._unit(rows) @ vantage)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = rows[order[:half]], rows[order[half:]]
        return at, d[order[half - 1]], d[order[half]], self._build(np.sort(inner), vantages, leaves), self._build(np.sort(outer), vantages, leaves)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, dots) of up to k nearest points of each unit query within its radius, -1 where none.

        ``own`` is the row that is the query itself, or -1. A subtree is left out where the
        triangle inequality, with the distance to the k-th neighbour so far multiplied by
        ``factor``, excludes it: at 1 nothing is missed, below 1 more is left out.
        """
        self.queries, self.own, self.k, self.factor = queries, own, k, factor
        self.short_queries = queries.astype(np.float32)
        self.to_vantages = distances(queries @ self.vantages.T)
        self.best = np.full((len(queries), k), -1, np.int64)
        self.dots = np.full((len(queries), k), -np.inf)
        self.reach = radius.astype(float).copy()
        if len(self.vectors) and len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.best, self.dots

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if len(node) == 2:
            self._take(q, *node)
            return
        vantage, inner_far, outer_near, inner, outer = node
        d = self.to_vantages[q, vantage]
        near = d < (inner_far + outer_near) / 2
        self._visit(inner, q[near])
        self._visit(outer, q[~near])
        cross = near & (_apart(d, outer_near) <= self.factor * self.reach[q] + 1e-9)
        self._visit(outer, q[cross])
        cross = ~near & (_apart(inner_far, d) <= self.factor * self.reach[q] + 1e-9)
        self._visit(inner, q[cross])

    def _take(self, q: np.ndarray, begin: int, end: int) -> None:
        least = 1.0 - self.reach[q] ** 2 / 2 - 1e-12
        hit = (self.short_queries[q] @ self.short[begin:end].T).max(axis=1) >= least - 1e-5
        if not hit.any():
            return
        q, least, rows = q[hit], least[hit], self.order[begin:end]
        dots = self.queries[q] @ self._unit(rows).T
        dots[(self.own[q][:, None] == rows[None, :]) | (dots < least[:, None])] = -np.inf
        # what is near moves to the left, as far as it is needed
        at, column = np.nonzero(dots > -np.inf)
        count = np.bincount(at, minlength=len(q))
        slot = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        near, near_rows = np.full((len(q), count.max()), -np.inf), np.full((len(q), count.max()), -1, np.int64)
        near[at, slot], near_rows[at, slot] = dots[at, column], rows[column]
        all_dots = np.concatenate([self.dots[q], near], axis=1)
        all_rows = np.concatenate([self.best[q], near_rows], axis=1)
        order = np.lexsort((all_rows, -all_dots), axis=-1)[:, : self.k]
        self.dots[q] = np.take_along_axis(all_dots, order, axis=1)
        best = np.take_along_axis(all_rows, order, axis=1)
        self.best[q] = np.where(np.isneginf(self.dots[q]), -1, best)
        kth = self.dots[q, -1]
        self.reach[q] = np.where(np.isneginf(kth), self.reach[q], np.minimum(self.reach[q], distances(kth)))
