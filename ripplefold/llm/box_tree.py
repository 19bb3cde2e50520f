"""R-trees over integer points, packed by sort-tile-recursive, and best-first searches by inner product."""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np

LEAF = 256
FAN = 16


def tiles(points: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> list[np.ndarray]:
    """Rows in tiles of at most `leaf`: sorted by the first axis, cut into slices of whole tiles, and each slice by the next axes."""
    n = ceil(len(rows) / leaf)
    if n <= 1:
        return [rows]
    rows = rows[np.argsort(points[rows, axes[0]], kind="stable")]
    if len(axes) == 1:
        return [rows[k : k + leaf] for k in range(0, len(rows), leaf)]
    size = ceil(n / ceil(n ** (1 / len(axes)))) * leaf
    return [t for k in range(0, len(rows), size) for t in tiles(points, rows[k : k + size], axes[1:], leaf)]


class BoxTree:
    """Nodes with their boxes; a leaf's children are its points, which stand together in `order`. The root is the last node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        about = points.astype(np.float64)
        axes = np.argsort(-about.var(0), kind="stable").tolist() if len(points) else []
        used = axes[: max(1, int(np.log2(max(2, ceil(len(points) / leaf)))))]
        packed = tiles(points, np.arange(len(points)), used, leaf) if used else [np.arange(len(points))]
        self.order = np.concatenate(packed)
        self.points = points[self.order]
        ends = np.cumsum([len(t) for t in packed]).tolist()
        self.spans = list(zip([0, *ends], ends))
        self.leaves = len(self.spans)
        low, high = [self.points[a:b].min(0) for a, b in self.spans], [self.points[a:b].max(0) for a, b in self.spans]
        level = list(range(self.leaves))
        while len(level) > 1:  # a node takes the next ones of the level below
            above = []
            for k in range(0, len(level), fan):
                a, b = level[k], level[min(k + fan, len(level)) - 1] + 1
                above.append(len(self.spans))
                self.spans.append((a, b))
                low.append(np.array(low[a:b]).min(0))
                high.append(np.array(high[a:b]).max(0))
            level = above
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By anchor and node, the least and greatest inner product that the node's box allows: each coordinate's interval, summed."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Best:
    """The k first of the entries offered, which begin with the negated score; full lists know their kth score."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None) -> None:
        self.k, self.low, self.high, self.entries = k, low, high, []

    def least(self) -> int | None:
        """A score strictly below it can't enter; None: any can."""
        kth = -self.entries[-1][0] if len(self.entries) == self.k else None
        return kth if self.low is None or kth is not None and kth > self.low else self.low

    def may_hold(self, lower: int, upper: int) -> bool:
        least = self.least()
        return (least is None or upper >= least) and (self.high is None or lower <= self.high)

    def offer(self, scores: np.ndarray, allowed: np.ndarray, entry) -> None:
        """entry(place) makes the rest of an entry; places are those of scores."""
        least = self.least()
        if least is not None:
            allowed = allowed & (scores >= least)
        if self.high is not None:
            allowed = allowed & (scores <= self.high)
        places = np.flatnonzero(allowed)
        if len(places) > 4 * self.k:  # only the k greatest scores, with all that equal the kth
            own = scores[places]
            places = places[own >= np.sort(own)[-self.k]]
        if len(places):
            self.entries = sorted(self.entries + [(-int(scores[p]), *entry(p)) for p in places.tolist()])[: self.k]


def search(tree: BoxTree, anchor: np.ndarray, lower: np.ndarray, upper: np.ndarray, wanted: list[Best], allowed, entry) -> None:
    """Offers points to the lists of `wanted`, best-first: the node with the greatest upper bound next, until none that is left
    may hold anything. allowed(first, last) says which of the tree's points count, entry(place) what stands for one."""
    root = len(tree.spans) - 1
    queue = [(-upper[root], root)]
    while queue:
        bound, node = heapq.heappop(queue)
        if not any(w.least() is None or -bound >= w.least() for w in wanted):
            return
        if not any(w.may_hold(lower[node], upper[node]) for w in wanted):
            continue
        a, b = tree.spans[node]
        if node >= tree.leaves:
            for child in range(a, b):
                heapq.heappush(queue, (-upper[child], child))
            continue
        scores, may = tree.points[a:b] @ anchor, allowed(a, b)
        for w in wanted:
            if w.may_hold(lower[node], upper[node]):
                w.offer(scores, may, lambda p: entry(a + p))  # noqa: B023
