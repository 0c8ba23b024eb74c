"""A k-d tree over points in arrays, and exact searches in it; what a task does with one block of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Points of a leaf inside a block; queries that are searched together; pairs that are looked at together.
LEAF, TOGETHER, PAIRS = 32, 8192, 1 << 21

Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every place of the spans, one after the other."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class BoxTree:
    """Nodes 1 to 2^depth - 1 split the widest axis near the median, values up to the split to the left; leaves follow. Equal points share a leaf, which may be empty."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.first = 1 << self.depth
        self.axis, self.split = np.zeros(self.first, np.int8), np.full(self.first, np.inf)
        parts = {1: np.arange(len(x))}
        for n in range(1, self.first):
            own = parts.pop(n)
            v = x[own]
            if len(own) > 1 and (wide := np.ptp(v, axis=0)).max() > 0:
                a = int(np.argmax(wide))
                v = v[:, a]
                at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
                if at == (top := v.max()):
                    at = v[v < top].max()
                self.axis[n], self.split[n] = a, at
                left = v <= at
                parts[2 * n], parts[2 * n + 1] = own[left], own[~left]
            else:
                parts[2 * n], parts[2 * n + 1] = own, own[:0]
        self.lo, self.hi = np.full((2 * self.first, 3), np.inf), np.full((2 * self.first, 3), -np.inf)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.split[node])
        return node - self.first

    def set_boxes(self, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The extents of the leaves' points, and from them those of all nodes."""
        self.lo[leaf + self.first], self.hi[leaf + self.first] = lo, hi
        for n in range(self.first - 1, 0, -1):
            self.lo[n] = np.minimum(self.lo[2 * n], self.lo[2 * n + 1])
            self.hi[n] = np.maximum(self.hi[2 * n], self.hi[2 * n + 1])

    def within(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves whose boxes are no farther than ``far``."""
        limit = far * far * (1 + 1e-12)
        q, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for level in range(self.depth + 1):
            out = np.maximum(np.maximum(self.lo[node] - x[q], x[q] - self.hi[node]), 0.0)
            near = (self.lo[node, 0] < np.inf) & ((out * out).sum(axis=1) <= limit[q])
            q, node = q[near], node[near]
            if level < self.depth:
                q, node = np.repeat(q, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
        return q, node - self.first


class Block:
    """Points in order of their ids, and the nearest of them."""

    def __init__(self, x: np.ndarray):
        self.tree = BoxTree(x, len(x) // LEAF)
        leaf = self.tree.leaf_of(x)
        self.order = np.argsort(leaf, kind="stable")
        self.x = x[self.order]
        self.size = np.bincount(leaf, minlength=self.tree.first)
        self.start = np.cumsum(self.size) - self.size
        some = np.flatnonzero(self.size)
        if len(some):
            self.tree.set_boxes(some, np.minimum.reduceat(self.x, self.start[some]), np.maximum.reduceat(self.x, self.start[some]))

    def met(self, x: np.ndarray, q: np.ndarray, leaf: np.ndarray, far: np.ndarray, accept: Accept | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, point, distance) of the points of these leaves, up to ``far``, some at a time."""
        upto = np.cumsum(self.size[leaf])
        at = 0
        while at < len(q):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            row, place = spans(self.start[leaf[at:stop]], self.size[leaf[at:stop]])
            who = q[at:stop][row]
            d = x[who] - self.x[place]
            d *= d
            dist = np.sqrt(d[:, 0] + d[:, 1] + d[:, 2])
            near = dist <= far[who]
            who, point, dist = who[near], self.order[place[near]], dist[near]
            if accept is not None:
                good = accept(who, point)
                who, point, dist = who[good], point[good], dist[good]
            yield who, point, dist
            at = stop

    def nearest(self, x: np.ndarray, k: int, far: np.ndarray, accept: Accept | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance), by query, of the ``k`` nearest points up to ``far`` each, ties to the smaller point."""
        parts = []
        for at in range(0, len(x), TOGETHER):
            some, limit = x[at : at + TOGETHER], far[at : at + TOGETHER].copy()
            mine = None if accept is None else (lambda q, t, at=at: accept(q + at, t))
            q, t, d = best(self.met(some, np.arange(len(some)), self.tree.leaf_of(some), limit, mine), k)
            full = np.flatnonzero(np.bincount(q, minlength=len(some)) == k)
            last = np.searchsorted(q, full, "right") - 1
            limit[full] = d[last]
            q, t, d = best(self.met(some, *self.tree.within(some, limit), limit, mine), k)
            parts.append((q + at, t, d))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first of each query by distance and point."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def first() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, t, d = (np.concatenate(c) for c in zip(*held, strict=True))
        o = np.lexsort((t, d, q))
        q, t, d = q[o], t[o], d[o]
        few = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        return q[few], t[few], d[few]

    for part in found:
        held.append(part)
        rows += len(part[0])
        if rows > PAIRS:
            held = [first()]
            rows = len(held[0][0])
    return first() if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
