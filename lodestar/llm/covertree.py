"""Cover trees over unit vectors and their dual traversal, in memory.

Levels are nested: a node's first child has the node's own centre, and each level halves the radius within which a
child must lie of its centre. Every node also knows its covering radius, the largest distance from its centre to a
member. A pair of nodes is dropped when even their closest members must be too far apart, taken whole when even their
farthest members must be near enough, and opened otherwise; members of small nodes are compared one by one, by cosine
in double precision.
"""

from __future__ import annotations

import pickle

import numpy as np

#: Distances of unit vectors come from cosines, whose rounding can reach this much near 0.
SLACK = 1e-7
LEAF = 24
#: Possible centres whose distances are found by one product.
CENTRES = 64


class CoverTree:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        v = np.asarray(vectors, np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norms
        n = len(v)
        unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        order: list[int] = []
        nodes: list[list] = []  # centre, lo, hi, covering radius, first child, last child
        # depth first for the order of members, breadth kept by child lists
        kids: list[list[int]] = []

        def grow(members: np.ndarray, radius: float) -> int:
            me = len(nodes)
            nodes.append([int(members[0]), len(order), 0, 0.0])
            kids.append([])
            far = _dist(unit[members], unit[members[:1]])[:, 0]
            nodes[me][3] = float(far.max())
            if len(members) <= LEAF or nodes[me][3] <= SLACK:
                order.extend(members.tolist())
            else:
                step = radius / 2
                while step >= nodes[me][3]:  # levels at which nothing splits are skipped
                    step /= 2
                rest, parts = members, []
                while len(rest):  # the first member left is the next centre; distances come for many at once
                    near = _dist(unit[rest], unit[rest[:CENTRES]]) <= step
                    taken = np.zeros(len(rest), bool)
                    for j in range(near.shape[1]):
                        if not taken[j]:
                            own = near[:, j] & ~taken
                            own[j] = True
                            parts.append(rest[own])
                            taken |= own
                    rest = rest[~taken]
                for p in parts:
                    kids[me].append(grow(p, step))
            nodes[me][2] = len(order)
            return me

        if n:
            grow(np.arange(n), 2.0)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.ids, self.weights, self.unit = np.asarray(ids)[order], np.asarray(weights)[order], unit[order]
        self.centre = rank[np.array([x[0] for x in nodes], np.int64)] if nodes else np.zeros(0, np.int64)
        self.lo, self.hi = (np.array([x[k] for x in nodes], np.int64) for k in (1, 2))
        self.cover = np.array([x[3] for x in nodes])
        self.kids = [np.array(k, np.int64) for k in kids]

    def dump(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Links:
    """Weighted numbers of links and a spanning forest over the members of one or two trees."""

    def __init__(self, a: CoverTree, b: CoverTree, same: bool):
        self.na = len(a.ids)
        self.w = a.weights if same else np.concatenate([a.weights, b.weights])
        self.count = np.zeros(len(self.w), np.int64)
        self.label = np.arange(len(self.w))
        self.edges: list[tuple[int, int]] = []
        self.shift = 0 if same else self.na

    def join(self, members: np.ndarray) -> None:
        labs, first = np.unique(self.label[members], return_index=True)
        if len(labs) > 1:
            at = members[first]
            self.edges += [(int(at[0]), int(x)) for x in at[1:]]
            self.label[np.isin(self.label, labs)] = labs[0]


def dual_links(a: CoverTree, b: CoverTree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links added, edge starts, edge ends) for all pairs of members with at least ``cosine``."""
    eps = float(np.sqrt(2.0 - 2.0 * cosine))
    out = Links(a, b, same)
    wa, wb = a.weights, b.weights
    stack = [(0, 0)] if len(a.ids) and len(b.ids) else []
    while stack:
        x, y = stack.pop()
        own = same and x == y
        ax, by = np.arange(a.lo[x], a.hi[x]), np.arange(b.lo[y], b.hi[y])
        if own:
            far = 2 * a.cover[x]
        else:
            d = float(_dist(a.unit[a.centre[x] : a.centre[x] + 1], b.unit[b.centre[y] : b.centre[y] + 1])[0, 0])
            if d - a.cover[x] - b.cover[y] > eps + SLACK:
                continue
            far = d + a.cover[x] + b.cover[y]
        if far < eps - SLACK:  # every member of one is near every member of the other
            if own:
                out.count[ax] += wa[ax].sum() - wa[ax]
                out.join(ax)
            else:
                out.count[ax] += wb[by].sum()
                out.count[by + out.shift] += wa[ax].sum()
                out.join(np.concatenate([ax, by + out.shift]))
            continue
        kx, ky = a.kids[x], b.kids[y]
        if not len(kx) and not len(ky):
            near = a.unit[ax] @ b.unit[by].T >= cosine
            if own:
                np.fill_diagonal(near, False)
                out.count[ax] += near @ wa[ax]
            else:
                out.count[ax] += near @ wb[by]
                out.count[by + out.shift] += near.T @ wa[ax]
            for r in np.flatnonzero(near.any(axis=1)):
                out.join(np.concatenate([ax[r : r + 1], by[near[r]] + out.shift]))
            continue
        kx = kx if len(kx) else np.array([x])
        ky = ky if len(ky) else np.array([y])
        d = _dist(a.unit[a.centre[kx]], b.unit[b.centre[ky]]) - a.cover[kx][:, None] - b.cover[ky][None, :] <= eps + SLACK
        if own:
            d = np.triu(d)  # each pair of children once
        stack += [(int(kx[i]), int(ky[j])) for i, j in zip(*np.nonzero(d), strict=True)]
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    s, e = (np.array([p[k] for p in out.edges], np.int64) for k in (0, 1))
    return ids, out.count, ids[s] if len(s) else s, ids[e] if len(e) else e
