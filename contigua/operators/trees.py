"""Numbers of spanning trees of graphs, and of clusters while they merge."""

from __future__ import annotations

import heapq

import numpy as np

#: Neighbours beyond which eliminating a node one by one no longer pays, and the rest is factored as a dense matrix.
DENSE_FROM = 48


def log_trees(n: int, edges: list[tuple[int, int]], weights: list[float] | None = None) -> float:
    """ln of the (weighted) number of spanning trees.

    Nodes are eliminated, those with the fewest neighbours first: a node of total weight W counts as a factor W, and joins
    its neighbours by edges of weight w_i w_j / W. On planar graphs few edges arise. What is dense at last is factored whole.
    One node has one tree; loops don't count; a disconnected graph has none (-inf).
    """
    if n <= 1:
        return 0.0
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for k, (a, b) in enumerate(edges):
        if a != b:
            w = 1.0 if weights is None else float(weights[k])
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    heap = [(len(d), i) for i, d in enumerate(near)]
    heapq.heapify(heap)
    gone, left, total = np.zeros(n, bool), n, 0.0
    while left > 1:
        degree, v = heapq.heappop(heap)
        if gone[v] or degree != len(near[v]):
            continue
        if not degree:
            return -np.inf
        if degree > DENSE_FROM:
            break
        around = near[v]
        whole = sum(around.values())
        total += float(np.log(whole))
        gone[v] = True
        left -= 1
        rest = list(around.items())
        for j, _ in rest:
            del near[j][v]
        for i, (a, wa) in enumerate(rest):
            mine, share = near[a], wa / whole
            for b, wb in rest[i + 1 :]:
                w = share * wb
                mine[b] = mine.get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        for j, _ in rest:
            heapq.heappush(heap, (len(near[j]), j))
        near[v] = {}
    if left > 1:
        rows = np.flatnonzero(~gone)
        at = {int(v): i for i, v in enumerate(rows)}
        lap = np.zeros((left, left))
        for v, i in at.items():
            for j, w in near[v].items():
                lap[i, at[j]] -= w
                lap[i, i] += w
        sign, value = np.linalg.slogdet(lap[1:, 1:])
        return total + float(value) if sign > 0 else -np.inf
    return total


class _Part:
    """The part of a grounded inverse that belongs to a cluster's nodes with neighbours outside, with room to grow."""

    def __init__(self, member: np.ndarray, held: np.ndarray):
        self.size = len(member)
        self.member, self.held = member, held

    def room(self, more: int) -> None:
        if self.size + more > len(self.held):
            wide = int(1.3 * (self.size + more)) + 4
            held, member = np.zeros((wide, wide)), np.zeros(wide, int)
            held[: self.size, : self.size] = self.held[: self.size, : self.size]
            member[: self.size] = self.member[: self.size]
            self.held, self.member = held, member


class TreeCounts:
    """ln tau of each cluster, and of the union of two neighbours, from inverses of grounded Laplacians.

    With cut edges (u0, v0), ..., ln tau(g + h) = ln tau(g) + ln tau(h) + ln det M where M = I + 11' + the differences of
    the cut's ends under both inverses, taken to the first cut edge. A bridge adds nothing. Where the graph is a forest no
    inverse is ever needed. A merge updates the larger cluster's inverse in place by the cut's rank.

    Cuts end at nodes that have neighbours outside their cluster, and the update of these nodes' part of the inverse needs
    no other part, so only that part is kept: in a plane a compact cluster of n nodes has about a multiple of sqrt(n) of them.
    """

    def __init__(self, rows: int, forest: bool, edges: np.ndarray):
        self.forest = forest
        self.value = np.zeros(2 * rows - 1)
        self.part: dict[int, _Part] = {}
        self.place = np.zeros(rows, int)
        self.outside = np.bincount(np.asarray(edges, int).ravel(), minlength=rows)

    def gains(self, g: int, cuts: list[tuple[int, list[int], list[int]]]) -> np.ndarray:
        """ln tau(g + h) - ln tau(g) - ln tau(h) for each (h, ends in g, ends in h), those of equal cut size together."""
        out = np.zeros(len(cuts))
        sizes: dict[int, list[int]] = {}
        for k, (_, u, _) in enumerate(cuts):
            if len(u) > 1:
                sizes.setdefault(len(u), []).append(k)
        mine = self.part.get(g)
        for c, which in sizes.items():
            if self.forest:
                out[which] = np.log(c)
                continue
            both = np.zeros((len(which), c, c))
            if mine is not None:
                p = self.place[[cuts[k][1] for k in which]]
                both += mine.held[p[:, :, None], p[:, None, :]]
            for i, k in enumerate(which):
                theirs = self.part.get(cuts[k][0])
                if theirs is not None:
                    q = self.place[cuts[k][2]]
                    both[i] += theirs.held[q[:, None], q[None]]
            m = np.eye(c - 1) + 1.0 + both[:, 1:, 1:] - both[:, 1:, :1] - both[:, :1, 1:] + both[:, :1, :1]
            out[which] = np.maximum(0.0, np.log(m[:, 0, 0]) if c == 2 else np.linalg.slogdet(m)[1])
        return out

    def merge(self, w: int, g: int, h: int, u: list[int], v: list[int], gain: float) -> None:
        """Clusters g and h become w. The cut's edges are from u in g to v in h."""
        self.value[w] = self.value[g] + self.value[h] + gain
        if self.forest:
            return
        a = self.part.pop(g, None) or _Part(np.array([g]), np.zeros((1, 1)))
        b = self.part.pop(h, None) or _Part(np.array([h]), np.zeros((1, 1)))
        if b.size > a.size:
            a, b, u, v = b, a, v, u
        n, k = a.size, b.size
        a.room(k)
        full, other = a.held, b.held[:k, :k]
        p0, q0 = self.place[u[0]], self.place[v[0]]
        full[n : n + k, :n] = full[p0, :n]
        full[:n, n : n + k] = full[:n, p0][:, None]
        full[n : n + k, n : n + k] = full[p0, p0] + 1 + other - other[:, q0][:, None] - other[q0][None] + other[q0, q0]
        a.member[n : n + k] = b.member[:k]
        self.place[b.member[:k]] += n
        a.size = n + k
        if len(u) > 1:
            p, q = self.place[u[1:]], self.place[v[1:]]
            side = full[: n + k, p] - full[: n + k, q]
            core = np.eye(len(p)) + side[p] - side[q]
            across = np.linalg.solve(core, side.T)
            for at in range(0, n + k, 256):
                full[at : min(at + 256, n + k), : n + k] -= side[at : at + 256] @ across
        np.subtract.at(self.outside, [*u, *v], 1)
        keep = self.outside[a.member[: a.size]] > 0
        if keep.sum() < 0.7 * a.size or a.size < 8:
            members = a.member[: a.size][keep]
            a = _Part(members, full[: n + k, : n + k][np.ix_(keep, keep)])
            self.place[members] = np.arange(len(members))
        self.part[w] = a
