"""Navigable small-world graphs held in memory, for any metric; searches of many queries walk at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Links that a new node gets, and room for those that it is given later.
LINKS, ROOM = 12, 36


class SmallWorld:
    """A graph of points (rows of an array) under metric(a, b): distances of shape (q, m) for a of (q, 1, ...) and b of (q, m, ...).

    Nodes come in by batches that double; each is linked both ways to the
    nearest that a search of the graph so far, and its own batch, hold. A full
    list of links gives up a later one, never the node's own. Equal points give
    equal graphs.
    """

    def __init__(self, points: np.ndarray, metric: Callable[[np.ndarray, np.ndarray], np.ndarray], beam: int = 24):
        count = len(points)
        self.points, self.metric = points, metric
        self.links, self.degree = np.full((count, ROOM), -1, np.int32), np.zeros(count, np.int64)
        self.known, self.rng = min(count, 32), np.random.default_rng(count)
        none = np.zeros((self.known, 0), np.int64)
        self._join(np.arange(self.known), none, none)
        while self.known < count:
            new = np.arange(self.known, min(count, 2 * self.known, self.known + 256))
            self._join(new, *self.search(points[new], beam))
            self.known = int(new[-1]) + 1

    def _join(self, new: np.ndarray, near: np.ndarray, dist: np.ndarray) -> None:
        own = self.metric(self.points[new][:, None], np.broadcast_to(self.points[new], (len(new), *self.points[new].shape))).astype(float)
        np.fill_diagonal(own, np.inf)
        ids, dist = np.concatenate([near, np.broadcast_to(new, own.shape)], 1), np.concatenate([dist, own], 1)
        k = min(LINKS, dist.shape[1])
        if not k:
            return
        at = np.argpartition(dist, k - 1, 1)[:, :k]
        real = np.isfinite(np.take_along_axis(dist, at, 1)).ravel()
        row, other = np.repeat(new, k)[real], np.take_along_axis(ids, at, 1).ravel()[real]
        width = len(self.points)
        row, other = np.divmod(np.unique(np.concatenate([row * width + other, other * width + row])), width)
        slot = self.degree[row] + np.arange(len(row)) - np.searchsorted(row, row)
        full = slot >= ROOM
        slot[full] = self.rng.integers(LINKS, ROOM, full.sum())
        self.links[row, slot] = other
        np.maximum.at(self.degree, row, slot + 1)

    def search(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest nodes that a beam of this width finds, nearest first, and their distances (-1 and infinity where there are fewer).

        own says which node each query is: the walk begins there, and never returns it.
        """
        known, count = self.known, len(queries)
        seen = np.zeros((count, known + 1), bool)
        ids, dist, done = np.full((count, beam), -1), np.full((count, beam), np.inf), np.zeros((count, beam), bool)
        fresh = np.tile(np.unique(np.linspace(0, known - 1, 4).astype(int)), (count, 1))
        if own is not None:
            seen[np.arange(count), own] = True
            fresh = np.concatenate([fresh, self.links[own]], 1)
        live = np.arange(count)
        while len(live):
            new = np.where((fresh >= 0) & (fresh < known), fresh, known)
            new = np.where(np.take_along_axis(seen[live], new, 1), known, new)
            new.sort(1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = known
            seen[live[:, None], new] = True
            seen[:, known] = False
            real = new < known
            d = np.where(real, self.metric(queries[live][:, None], self.points[np.where(real, new, 0)]), np.inf)
            both = [np.concatenate(x, 1) for x in ((ids[live], np.where(real, new, -1)), (dist[live], d), (done[live], np.zeros(new.shape, bool)))]
            at = np.argpartition(both[1], beam - 1, 1)[:, :beam]
            ids[live], dist[live], done[live] = (np.take_along_axis(x, at, 1) for x in both)
            ahead = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
            pick = ahead.argmin(1)
            go = np.isfinite(ahead[np.arange(len(live)), pick])
            live, pick = live[go], pick[go]
            done[live, pick] = True
            fresh = self.links[ids[live, pick]]
        order = np.argsort(dist, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
