"""Cover trees over unit vectors and their dual traversal; used inside tasks on bounded blocks."""

from __future__ import annotations

import numpy as np

from ripplefold.llm.common import Forest

SLACK = 1e-7  # more than double precision can be off for the distance of unit vectors, of equal ones too
LEAF = 256
CENTRES = 64


class Cover:
    """A node: its centre's row, the greatest distance to a row below it, its rows, and its children; a leaf has none."""

    __slots__ = ("row", "radius", "rows", "children")

    def __init__(self, row: int, radius: float, rows: np.ndarray, children: list) -> None:
        self.row, self.radius, self.rows, self.children = row, radius, rows, children


def away(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances of rows from one vector, by differences: products would lose small distances to rounding."""
    return np.sqrt(np.square(rows - centre).sum(1))


def single_slack(length: int) -> float:
    """More than a product of unit vectors of this length can be off in single precision: one rounding for each
    component of either vector, each product and each sum."""
    return (length + 4) * 2.0**-23


def build(x: np.ndarray, rows: np.ndarray, centre: int, scale: float = 2.0) -> Cover:
    """The subtree over rows around one of them. The children of a level lie within half of its scale of their centres, and so on
    down. Where CENTRES centres of half the scale don't gather half of the rows, closer levels would not either, and the node is a leaf."""
    radius = max(float(away(x[rows[k : k + 4096]], x[centre]).max()) for k in range(0, len(rows), 4096)) + SLACK
    while scale / 2 > radius:
        scale /= 2
    if len(rows) <= LEAF or radius <= 2 * SLACK:
        return Cover(centre, radius, rows, [])
    free, groups = np.concatenate([[centre], rows[rows != centre]]), []
    while len(free) and len(groups) < CENTRES:
        near = x[free] @ x[free[0]] >= 1 - (scale / 2) ** 2 / 2
        near[0] = True
        groups.append((int(free[0]), free[near]))
        free = free[~near]
    if len(free) * 2 > len(rows):
        return Cover(centre, radius, rows, [])
    children = [build(x, mine, row, scale / 2) for row, mine in groups]
    if len(free):
        children.append(build(x, free, int(free[0]), scale / 2))
    return Cover(centre, radius, rows, children)


def link_near(exact_x: np.ndarray, exact_y: np.ndarray, same: bool, least: float, weight_x: np.ndarray, weight_y: np.ndarray, names_x: list, names_y: list, forest: Forest, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The weight of the rows of y (x) that each row of x (y) reaches a cosine of `least` with; joins them in `forest`.

    A pair of nodes is left out when its centres are further apart than the threshold's chord and both radii, all in double
    precision. Products of the rows that are left are taken in single precision first; those that reach the threshold less
    what single precision can be off are taken again in double precision.
    """
    chord, loose = float(np.sqrt(2 - 2 * least)), single_slack(exact_x.shape[1])
    x, y = exact_x.astype(np.float32), exact_y.astype(np.float32)
    n_x, n_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    tree_x = build(exact_x, np.arange(len(x)), 0)
    tree_y = tree_x if same else build(exact_y, np.arange(len(y)), 0)

    def verify(a: np.ndarray, b: np.ndarray, within: bool) -> None:
        step = max(1, at_once // len(b))
        for at in range(0, len(a), step):
            part, rest = a[at : at + step], b[at:] if within else b  # within one set, a row only meets those behind it
            i, j = np.nonzero(x[part] @ y[rest].T >= least - loose)
            if within:
                behind = j > i
                i, j = i[behind], j[behind]
            i, j = part[i], rest[j]
            ok = np.ones(len(i), bool)
            for k in range(0, len(i), 1 << 18):
                cut = slice(k, k + (1 << 18))
                ok[cut] = np.einsum("ij,ij->i", exact_x[i[cut]], exact_y[j[cut]]) >= least
            i, j = i[ok], j[ok]
            np.add.at(n_x, i, weight_y[j])
            np.add.at(n_y, j, weight_x[i])
            join_pairs(i, j)

    def join_pairs(i: np.ndarray, j: np.ndarray) -> None:
        """Rows with many pairs are joined by way of those already connected, so that the loop stays short."""
        if len(i) > 4096:
            keep = np.unique(np.concatenate([np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]]))
            for p, q in zip(i[keep].tolist(), j[keep].tolist()):
                forest.join(names_x[p], names_y[q])
            rows, other = np.unique(i), np.unique(j)
            top = {**{("x", p): forest.root(names_x[p]) for p in rows.tolist()}, **{("y", q): forest.root(names_y[q]) for q in other.tolist()}}
            root_i = np.array([top["x", p] for p in rows.tolist()])[np.searchsorted(rows, i)]
            root_j = np.array([top["y", q] for q in other.tolist()])[np.searchsorted(other, j)]
            apart = root_i != root_j
            i, j = i[apart], j[apart]
        for p, q in zip(i.tolist(), j.tolist()):
            forest.join(names_x[p], names_y[q])

    stack = [(tree_x, tree_y)]
    while stack:
        a, b = stack.pop()
        within = same and a is b
        if not within and float(away(exact_x[[a.row]], exact_y[b.row])[0]) > chord + SLACK + a.radius + b.radius:
            continue
        if not a.children and not b.children:
            verify(a.rows, b.rows, within)
        elif within:
            stack.extend((p, q) for k, p in enumerate(a.children) for q in a.children[k:])
        elif a.children and (not b.children or len(a.rows) >= len(b.rows)):
            stack.extend((p, b) for p in a.children)
        else:
            stack.extend((a, q) for q in b.children)
    return (n_x + n_y, n_y) if same else (n_x, n_y)
