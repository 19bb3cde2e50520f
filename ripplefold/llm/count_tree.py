"""An R-tree over count vectors, joined with itself under an overlap bound; used inside tasks on bounded blocks."""

from __future__ import annotations

import numpy as np

from ripplefold.llm.common import Forest

GROUPS = 64
FANOUT = 64


def count_vector(items: np.ndarray) -> np.ndarray:
    """How many of a set's hashed items fall into each of GROUPS groups."""
    return np.bincount((items >> np.uint64(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def needed(a, b, num: int, den: int):
    """The smallest overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-(num * (a + b)) // (num + den))


class Node:
    """A rectangle of count vectors: per-group maxima and the range of set sizes."""

    __slots__ = ("members", "children", "most", "least_size", "most_size", "label")

    def __init__(self, members, children, most, least_size, most_size) -> None:
        self.members, self.children, self.most, self.least_size, self.most_size, self.label = members, children, most, least_size, most_size, None


def bulk_load(sizes: np.ndarray, vectors: np.ndarray) -> Node:
    """Sort-tile packing: by size first, then by the group that spreads most within each tile."""
    order = np.argsort(sizes, kind="stable")
    level = []
    for i in range(0, len(order), FANOUT * FANOUT):
        tile = order[i : i + FANOUT * FANOUT]
        tile = tile[np.argsort(vectors[tile][:, vectors[tile].var(0).argmax()], kind="stable")]
        for j in range(0, len(tile), FANOUT):
            leaf = tile[j : j + FANOUT]
            level.append(Node(leaf, None, vectors[leaf].max(0), sizes[leaf].min(), sizes[leaf].max()))
    while len(level) > 1:
        level = [Node(None, c := level[i : i + FANOUT], np.max([x.most for x in c], 0), min(x.least_size for x in c), max(x.most_size for x in c)) for i in range(0, len(level), FANOUT)]
    return level[0]


def link_sets(names: list[int], sizes: np.ndarray, vectors: np.ndarray, sets: list[np.ndarray] | None, num: int, den: int, forest: Forest, side: np.ndarray | None = None) -> None:
    """Joins in `forest` every two sets with den * overlap >= num * union, by dual traversal of the R-tree.

    Two nodes are left out when the summed minima of their per-group maxima stay below the overlap that
    their smallest sizes need, or when all they hold is connected already; what survives is verified on
    the sets themselves, or joined as it is where there are none. With `side`, only pairs from different
    sides are looked at.
    """
    def one_root(node: Node):
        """The single component that a node lies in, or None; once single it stays so."""
        if node.label is None:
            if node.children is not None:
                found = {one_root(c) for c in node.children}
                if None in found:
                    return None
            else:
                found = {int(names[i]) for i in node.members}
            found = {forest.root(x) for x in found}
            if len(found) > 1:
                return None
            node.label = found.pop()
        return forest.root(node.label)

    def may(a: Node, b: Node) -> bool:
        if den * min(a.most_size, b.most_size) < num * max(a.least_size, b.least_size):
            return False
        if np.minimum(a.most, b.most).sum() < needed(a.least_size, b.least_size, num, den):
            return False
        x = one_root(a)
        return x is None or x != one_root(b)

    stack = [(root := bulk_load(sizes, vectors), root)]
    while stack:
        a, b = stack.pop()
        if not may(a, b):
            continue
        if a.children is not None:
            same = a is b
            for i, x in enumerate(a.children):
                stack.extend((x, y) for y in (b.children[i:] if same else b.children))
            continue
        bound = np.minimum(vectors[a.members][:, None, :], vectors[b.members][None, :, :]).sum(2)
        passed = bound >= needed(sizes[a.members][:, None], sizes[b.members][None, :], num, den)
        for i, j in zip(*np.nonzero(passed)):
            p, q = int(a.members[i]), int(b.members[j])
            if p == q or (a is b and i > j) or (side is not None and side[p] == side[q]) or forest.root(names[p]) == forest.root(names[q]):
                continue
            if sets is None:
                forest.join(names[p], names[q])
                continue
            small, large = (sets[p], sets[q]) if sizes[p] <= sizes[q] else (sets[q], sets[p])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            if (large[at] == small).sum() >= needed(int(sizes[p]), int(sizes[q]), num, den):
                forest.join(names[p], names[q])
