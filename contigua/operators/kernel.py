"""Greedy merging of adjacent clusters: one sequential problem, run in one task."""

from __future__ import annotations

import heapq
from array import array
from dataclasses import dataclass

import numpy as np

from contigua.functions.special import lgamma
from contigua.operators.trees import TreeCounts, log_trees

#: Coarse levels whose prior between clusters is computed; finer ones are interpolated.
COARSE = 50
#: Edges that are looked at together, so that what is made of them needn't fit for all.
EDGES = 65_536


@dataclass
class Merged:
    pairs: np.ndarray  # (n - 1, 2), smaller node first
    cost: np.ndarray
    level: np.ndarray  # n; Bayesian: log likelihood plus priors, not negated
    center: np.ndarray
    size: np.ndarray
    prior_intra: np.ndarray
    prior_inter: np.ndarray
    prior_k: np.ndarray


def connected(n: int, edges: np.ndarray) -> bool:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left = n
    for at in range(0, len(edges), EDGES):
        for a, b in edges[at : at + EDGES].tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                left -= 1
    return left <= 1


def canonical(edges: np.ndarray) -> np.ndarray:
    """Undirected edges once each, smaller end first, in order, without loops."""
    e = np.asarray(edges).reshape(-1, 2)
    e = np.sort(e if e.dtype.kind == "i" else e.astype(int), axis=1)
    e = e[e[:, 0] != e[:, 1]]
    e = e[np.lexsort((e[:, 1], e[:, 0]))]
    return e[np.r_[True, (e[1:] != e[:-1]).any(axis=1)]] if len(e) else e


def greedy(n: int, edges: np.ndarray, state, bayesian: bool = False, approx: bool = False) -> Merged:
    """Merge the cheapest adjacent pair until one cluster is left.

    Equal costs are taken in the order in which pairs arose: first by (u, v), then for each new node by neighbours from
    the highest node down. Bayesian runs order merges by cost less the log number of spanning trees that the cut's choice
    leaves, unless approx, and add the priors of partitions to each level.
    """
    edges = canonical(edges)
    if not connected(n, edges):
        raise ValueError("The graph is not connected, several components found.")
    first = np.concatenate([np.zeros(0), *[state.cost(*edges[at : at + EDGES].T) for at in range(0, len(edges), EDGES)]])
    if not bayesian:
        return _by_cost(n, edges, first, state)
    edges = edges.astype(int)
    heap = [(c, s, u, v, c) for s, (c, (u, v)) in enumerate(zip(first.tolist(), edges.tolist(), strict=True))]
    heapq.heapify(heap)
    seq = len(heap)
    # near[g][h]: the cut's ends in g and in h, kept once for both directions
    near: list[dict[int, tuple[list[int], list[int]]]] = [{} for _ in range(2 * n - 1)]
    for u, v in edges.tolist():
        one, two = [u], [v]
        near[u][v] = one, two
        near[v][u] = two, one
    trees = TreeCounts(n, len(edges) < n, edges)
    alive = np.ones(2 * n - 1, bool)
    pairs, cost = np.zeros((max(n - 1, 0), 2), int), np.zeros(max(n - 1, 0))
    level, intra = np.full(n, state.start), np.zeros(n)
    k = np.arange(n, 0, -1.0)
    prior_k = lgamma(n + 1.0) - (lgamma(float(n)) - lgamma(k) - lgamma(n - k + 1)) - lgamma(k + 1)
    best, best_at = state.start, 0
    for m in range(n - 1):
        while True:
            if not heap:
                raise ValueError("The graph is not connected, several components found.")
            price, _, g, h, loss = heapq.heappop(heap)
            if alive[g] and alive[h]:
                break
        w = n + m
        pairs[m], cost[m] = (g, h), price
        if state.moving:
            loss = float(state.cost(g, np.array([h]))[0])
        mine, theirs = near[g][h]
        gain = float(trees.gains(g, [(h, mine, theirs)])[0])
        level[m + 1] = level[m] - loss
        intra[m + 1] = intra[m] + gain
        trees.merge(w, g, h, mine, theirs, gain)
        if level[m + 1] + prior_k[m + 1] > best:
            best, best_at = level[m + 1] + prior_k[m + 1], m
        state.merge(w, g, h, loss)
        alive[g] = alive[h] = False
        few, around = sorted((near[g], near[h]), key=len)  # what the larger one has is taken over as it is
        near[w] = around
        around.pop(g, None)
        around.pop(h, None)
        for j, (mine, theirs) in few.items():
            if j in (g, h):
                continue
            held = around.get(j)
            around[j] = (held[0] + mine, held[1] + theirs) if held else (mine, theirs)
        for j, (mine, theirs) in around.items():
            other = near[j]
            other.pop(g, None)
            other.pop(h, None)
            other[w] = theirs, mine
        near[g], near[h] = {}, {}
        order = sorted(around, reverse=True)
        if order:
            costs = state.cost(w, np.array(order))
            keys = costs
            if not approx and not trees.forest:
                keys = costs - (trees.gains(w, [(j, *around[j]) for j in order]) - np.log([len(around[j][0]) for j in order]))
            for j, key, c in zip(order, keys.tolist(), costs.tolist(), strict=True):
                heapq.heappush(heap, (key, seq, j, w, c))
                seq += 1
    inter = _between(n, edges, pairs, intra, best_at)
    level = level + (inter + intra - inter[0]) + prior_k
    return Merged(pairs, cost, level, state.x[n:], state.n[n:], intra, inter, prior_k)


class _Held:
    """Of each node since the rows, in order of cost: its neighbours when it arose, and what merging with them costs. What merged nodes held is cleared away."""

    def __init__(self, n: int):
        self.n, self.last, self.live = n, n - 1, 0
        self.ids, self.costs = array("i"), array("d")
        self.at, self.begin, self.end = (array("q", bytes(8 * (n - 1))) for _ in range(3))

    def put(self, w: int, ids: list[int], costs: list[float], top: array) -> None:
        if len(self.ids) - self.live > max(self.live, self.n):
            self._clear(top)
        i, self.last = w - self.n, w
        self.at[i] = self.begin[i] = len(self.ids)
        self.ids.extend(ids)
        self.costs.extend(costs)
        self.end[i] = len(self.ids)
        self.live += len(ids)

    def take(self, w: int) -> array:
        """The neighbours of a node that is merged now."""
        i = w - self.n
        out = self.ids[self.begin[i] : self.end[i]]
        self.live -= len(out)
        return out

    def _clear(self, top: array) -> None:
        """top: a node itself, unless it is merged."""
        ids, costs = array("i"), array("d")
        for i in range(self.last - self.n + 1):
            if top[i + self.n] == i + self.n:
                a, b, shift = self.begin[i], self.end[i], len(ids) - self.begin[i]
                ids.extend(self.ids[a:b])
                costs.extend(self.costs[a:b])
                self.at[i], self.begin[i], self.end[i] = self.at[i] + shift, a + shift, b + shift
            else:
                self.at[i] = self.begin[i] = self.end[i] = 0
        self.ids, self.costs = ids, costs


def _by_cost(n: int, edges: np.ndarray, first: np.ndarray, state) -> Merged:
    """The merges of canonical edges with the costs `first`, by cost alone, in room that grows with the edges and not with all pairs that arise.

    Pairs of rows are sorted once. A later pair is held by the node that it arose with; the heap has one pair of each such
    node, its cheapest that is left, so that (cost, holder) is the order of (cost, pair). What a node held when it arose
    also tells its neighbours: they are in the clusters that have since taken those nodes in.
    """
    order = np.argsort(first, kind="stable")
    low, high = (array("i", edges[order, c].astype(np.intc).tobytes()) for c in (0, 1))
    price = array("d", first[order].tobytes())
    holder, other = np.r_[edges[:, 0], edges[:, 1]].astype(np.intc), np.r_[edges[:, 1], edges[:, 0]].astype(np.intc)
    near = array("i", other[np.argsort(holder, kind="stable")].tobytes())
    begin = array("q", np.r_[0, np.cumsum(np.bincount(holder, minlength=n))].tobytes())
    del edges, first, order, holder, other
    s, held, heap = 0, _Held(n), []
    top = array("i", range(2 * n - 1))
    pairs, cost = np.zeros((n - 1, 2), np.intc), np.zeros(n - 1)
    for m in range(n - 1):
        while s < len(price) and (top[low[s]] != low[s] or top[high[s]] != high[s]):
            s += 1
        while heap:
            h = heap[0][1]
            if top[h] != h:
                heapq.heappop(heap)
                continue
            i, end = held.at[h - n], held.end[h - n]
            if top[held.ids[i]] == held.ids[i]:
                break
            while i < end and top[held.ids[i]] != held.ids[i]:
                i += 1
            held.at[h - n] = i
            if i < end:
                heapq.heapreplace(heap, (held.costs[i], h))
            else:
                heapq.heappop(heap)
        if s < len(price) and (not heap or price[s] <= heap[0][0]):
            g, h, loss = low[s], high[s], price[s]
        elif heap:
            loss, h = heapq.heappop(heap)
            g = held.ids[held.at[h - n]]
        else:
            raise ValueError("The graph is not connected, several components found.")
        w = n + m
        pairs[m], cost[m] = (g, h), loss
        state.merge(w, g, h, loss)
        top[g] = top[h] = w
        around = set()
        for k in (g, h):
            for j in near[begin[k] : begin[k + 1]] if k < n else held.take(k):
                while (up := top[j]) != j:
                    top[j] = top[up]
                    j = up
                around.add(j)
        around.discard(w)
        ids = sorted(around, reverse=True)
        if ids:
            costs = state.cost(w, np.array(ids)).tolist()
            by = sorted(range(len(ids)), key=costs.__getitem__)
            held.put(w, [ids[i] for i in by], [costs[i] for i in by], top)
            heapq.heappush(heap, (costs[by[0]], w))
    k = np.arange(n, 0, -1.0)
    prior_k = lgamma(n + 1.0) - (lgamma(float(n)) - lgamma(k) - lgamma(n - k + 1)) - lgamma(k + 1)
    return Merged(pairs.astype(int), cost, np.cumsum(np.r_[state.start, cost]), state.x[n:], state.n[n:], np.zeros(n), np.full(n, np.nan), prior_k)


def _between(n: int, edges: np.ndarray, pairs: np.ndarray, intra: np.ndarray, best_at: int) -> np.ndarray:
    """ln number of spanning trees of the graph of clusters, at coarse levels; a straight line before them."""
    inter = np.full(n, np.nan)
    inter[n - 1] = 0.0
    low = max(n - COARSE - 1, best_at, 0)
    if n > 1 and low <= n - 2:
        top = np.arange(2 * n - 1)  # the node of level `low` that holds a node
        for m in range(low):
            top[pairs[m]] = n + m
        for i in range(n + low - 1, -1, -1):
            top[i] = i if top[i] == i else top[top[i]]
        ends = top[edges]
        label = np.arange(2 * n - 1)
        for at in range(low, n - 1):
            a, b = label[ends[:, 0]], label[ends[:, 1]]
            cut = a != b
            names, flat = np.unique(np.stack([a[cut], b[cut]]), return_inverse=True)
            flat = flat.reshape(2, -1)
            lap = np.zeros((len(names), len(names)))
            np.add.at(lap, (flat[0], flat[0]), 1)
            np.add.at(lap, (flat[1], flat[1]), 1)
            np.add.at(lap, (flat[0], flat[1]), -1)
            np.add.at(lap, (flat[1], flat[0]), -1)
            inter[at] = np.linalg.slogdet(lap[1:, 1:])[1] if len(names) > 1 else 0.0
            label[np.isin(label, pairs[at])] = n + at
    missing = int(np.isnan(inter).sum())
    if missing:
        inter[:missing] = np.linspace(intra[-1], inter[missing], missing)
    return inter


def heights(level: np.ndarray) -> np.ndarray:
    """Heights of the n - 1 merges from levels in the sense of costs: slopes of the concave hull of -level against k.

    Past the best number of clusters they are 0; merges that the hull skips share one slope, so heights never fall.
    """
    n = len(level)
    gain = -np.asarray(level, float)[::-1]  # by k - 1
    top = int(np.argmax(gain))
    gain = gain.tolist()
    hull = [0]
    for k in range(1, top + 1):
        while len(hull) > 1 and (gain[k] - gain[hull[-1]]) * (hull[-1] - hull[-2]) >= (gain[hull[-1]] - gain[hull[-2]]) * (k - hull[-1]):
            hull.pop()
        hull.append(k)
    slope = np.zeros(max(n - 1, 0))
    for a, b in zip(hull, hull[1:], strict=False):
        slope[a:b] = (gain[b] - gain[a]) / (b - a)
    return slope[::-1].copy()


def leaf_order(n: int, pairs: np.ndarray) -> np.ndarray:
    """Leaves from left to right, each merge's first node to the left."""
    if n == 1:
        return np.array([0])
    out, stack = [], [2 * n - 2]
    while stack:
        i = stack.pop()
        if i < n:
            out.append(i)
        else:
            stack += [int(pairs[i - n][1]), int(pairs[i - n][0])]
    return np.array(out)


def cut_labels(n: int, pairs: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers 1 to k by first row, after the first n - k merges."""
    top = np.arange(2 * n - 1)
    for m in range(n - k):
        top[pairs[m]] = n + m
    for i in range(2 * n - 2, -1, -1):
        top[i] = i if top[i] == i else top[top[i]]
    _, first, label = np.unique(top[:n], return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(1, len(first) + 1)
    return rank[label]


__all__ = ["Merged", "canonical", "connected", "cut_labels", "greedy", "heights", "leaf_order", "log_trees"]
