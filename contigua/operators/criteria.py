"""Merge criteria: associative statistics of clusters with a pairwise cost, on arrays of all nodes of a run."""

from __future__ import annotations

import numpy as np

from contigua.functions.dirichlet import evidence
from contigua.functions.special import lgamma
from contigua.types import Method

LN_2PI = 1.8378770664093453


class Criterion:
    """State of up to 2n - 1 nodes. cost(g, hs): of merging node g with each of hs; start: level of all rows apart."""

    start = 0.0
    #: Whether a pair's cost changes while neither is merged.
    moving = False

    def __init__(self, x: np.ndarray, method: Method):
        rows, d = x.shape
        self.method = method
        self.n = np.ones(2 * rows - 1)
        self.x = np.zeros((2 * rows - 1, d))
        self.x[:rows] = x

    def cost(self, g: np.ndarray | int, hs: np.ndarray) -> np.ndarray:
        return ((self.x[g] - self.x[hs]) ** 2).sum(axis=-1)

    def merge(self, w: int, g: int, h: int, loss: float = 0.0) -> None:
        n = self.n[g] + self.n[h]
        self.x[w] = (self.x[g] * self.n[g] + self.x[h] * self.n[h]) / n
        self.n[w] = n


class Ward(Criterion):
    def cost(self, g, hs):
        return self.n[g] * self.n[hs] / (self.n[g] + self.n[hs]) * super().cost(g, hs)


class Median(Criterion):
    def merge(self, w, g, h, loss=0.0):
        self.x[w] = (self.x[g] + self.x[h]) / 2
        self.n[w] = self.n[g] + self.n[h]


class Summed(Criterion):
    """Nodes hold sums, not means."""

    def merge(self, w, g, h, loss=0.0):
        self.x[w] = self.x[g] + self.x[h]
        self.n[w] = self.n[g] + self.n[h]


class ChiSquare(Summed):
    def __init__(self, x, method):
        super().__init__(x, method)
        mass = np.trunc(x.sum()) if method.halves else x.sum()
        with np.errstate(divide="ignore"):
            self.w = np.where(x.sum(axis=0) > 0, mass / x.sum(axis=0), 0.0)

    def cost(self, g, hs):
        sg, sh = self.x[g].sum(axis=-1, keepdims=True), self.x[hs].sum(axis=-1, keepdims=True)
        with np.errstate(all="ignore"):
            gap = (self.w * (self.x[g] / sg - self.x[hs] / sh) ** 2).sum(axis=-1)
        return np.where(((sg == 0) | (sh == 0))[..., 0], 0.0, gap)


class Evidence(Criterion):
    """Bayesian criteria: cost is the log evidence lost by a merge. lp holds each node's log evidence."""

    def __init__(self, x, method):
        super().__init__(x, method)
        self.lp = np.zeros(len(self.n))
        self.prepare(x)
        rows = np.arange(len(x))
        self.lp[: len(x)] = self.joint(rows, None)
        self.start = float(self.lp[: len(x)].sum())

    def prepare(self, x: np.ndarray) -> None: ...

    def joint(self, g: np.ndarray | int, hs: np.ndarray | None) -> np.ndarray:
        """Log evidence of g alone, or together with each of hs."""
        raise NotImplementedError

    def cost(self, g, hs):
        return self.lp[g] + self.lp[hs] - self.joint(g, hs)

    def merge(self, w, g, h, loss=0.0):
        self.unite(w, g, h)
        self.lp[w] = self.lp[g] + self.lp[h] - loss

    def unite(self, w: int, g: int, h: int) -> None:
        super().merge(w, g, h)


class Multinomial(Evidence):
    def joint(self, g, hs):
        b = 1.0 if self.method.beta is None else self.method.beta
        x = self.x[g] if hs is None else self.x[g] + self.x[hs]
        n = self.n[g] if hs is None else self.n[g] + self.n[hs]
        d = x.shape[-1]
        return lgamma(d * b) + lgamma(x + b).sum(-1) - d * lgamma(b) - lgamma((x + b).sum(-1)) + lgamma(n + 1)

    def unite(self, w, g, h):
        self.x[w] = self.x[g] + self.x[h]
        self.n[w] = self.n[g] + self.n[h]


class Gaussian(Evidence):
    def prepare(self, x):
        m = self.method
        self.s = np.zeros_like(self.x)
        self.mu = x.mean(axis=0) if m.mu is None else np.asarray(m.mu, float)
        spread = ((x**2).mean(axis=0) - x.mean(axis=0) ** 2).sum()
        self.b = np.full(x.shape[1], 0.1 * spread if m.beta is None else m.beta)
        # what depends on the number of rows alone
        n = np.arange(len(x) + 1.0)
        self.half = np.floor(n / 2) if m.halves else n / 2
        self.fixed = x.shape[1] * (lgamma(m.kappa + self.half) - lgamma(m.kappa) + 0.5 * np.log(m.tau) - 0.5 * np.log(m.tau + n) - self.half * LN_2PI) + m.kappa * np.log(self.b).sum()

    def _pooled(self, g, hs):
        n = self.n[g] + self.n[hs]
        ng, nh = np.asarray(self.n[g])[..., None], self.n[hs][..., None]
        x = (self.x[g] * ng + self.x[hs] * nh) / n[..., None]
        return x, self.s[g] + self.s[hs] + ng * (self.x[g] - x) ** 2 + nh * (self.x[hs] - x) ** 2, n

    def joint(self, g, hs):
        x, s, n = (self.x[g], self.s[g], self.n[g]) if hs is None else self._pooled(g, hs)
        m, rows = self.method, np.asarray(n).astype(int)
        n = np.asarray(n, float)[..., None]
        bn = self.b + s / 2 + m.tau * n / (2 * (m.tau + n)) * (x - self.mu) ** 2
        return self.fixed[rows] - (m.kappa + self.half[rows]) * np.log(bn).sum(axis=-1)

    def unite(self, w, g, h):
        x, s, n = self._pooled(g, np.array([h]))
        self.x[w], self.s[w], self.n[w] = x[0], s[0], n[0]


class Composition(Evidence):
    def prepare(self, x):
        if (x <= 0).any():
            raise ValueError("all components must be above 0")
        lam = 0.01 if self.method.lam is None else self.method.lam
        self.lam = np.broadcast_to(np.asarray(lam, float), x.shape[1:]).copy()
        self.l = np.zeros_like(self.x)
        self.l[: len(x)] = np.log(x)

    def joint(self, g, hs):
        if hs is None:
            return evidence(self.n[g], self.lam, self.l[g], self.x[g], self.method.halves)
        n = self.n[g] + self.n[hs]
        mean = (self.x[g] * np.asarray(self.n[g])[..., None] + self.x[hs] * self.n[hs][..., None]) / n[..., None]
        return evidence(n, self.lam, self.l[g] + self.l[hs], mean, self.method.halves) + lgamma(n + 1)

    def unite(self, w, g, h):
        super().unite(w, g, h)
        self.l[w] = self.l[g] + self.l[h]


CRITERIA: dict[str, type[Criterion]] = {"ward": Ward, "centroid": Criterion, "median": Median, "chisq": ChiSquare, "bayes_mom": Multinomial, "bayes_dgmm": Gaussian, "bayes_dirichlet": Composition}


class Flows:
    """Planted degree-corrected block model: expected volumes differ inside and between blocks only.

    links_out[g] maps a node to the volume from g to it. The costs depend on the volume and pairs between all blocks, which
    merges change; a pair is priced when it arises, and the level uses the price at the merge.
    """

    start = 0.0
    moving = True

    def __init__(self, rows: int, volumes: list[tuple[int, int, float]], lam_in: float | None = None, lam_out: float | None = None, degrees_from_origin: bool = False):
        size = 2 * rows - 1
        self.n = np.ones(size)
        self.inside, self.din, self.dout = np.zeros(size), np.zeros(size), np.zeros(size)
        self.out: list[dict[int, float]] = [{} for _ in range(size)]
        self.into: list[dict[int, float]] = [{} for _ in range(size)]
        self.pairs, self.links = float(rows * (rows - 1)), 0.0
        every = 0.0
        for o, d, v in volumes:
            every += v
            if o == d:
                self.inside[o] += v
            else:
                self.out[o][d] = self.out[o].get(d, 0.0) + v
                self.into[d][o] = self.into[d].get(o, 0.0) + v
                self.links += v
            self.dout[o] += v
            self.din[o if degrees_from_origin else d] += v
        self.lam_in = every / rows**2 * 100 if lam_in is None else lam_in
        self.lam_out = every / rows**2 / 100 if lam_out is None else lam_out
        self.x = self.n[:, None]

    def _degree(self, n, k):
        return lgamma(n) + k * np.log(n) - lgamma(n + k)

    def _volume(self, e, lam, pairs):
        return lgamma(e + 1) + e * np.log(lam) - (e + 1) * np.log(lam * pairs + 1)

    def between(self, g: int, h: int) -> float:
        return self.out[g].get(h, 0.0) + self.out[h].get(g, 0.0)

    def cost(self, g, hs):
        gs = np.broadcast_to(g, np.shape(hs))
        mid = np.array([self.between(int(a), int(b)) for a, b in zip(gs, hs, strict=True)])
        n = self.n[gs] + self.n[hs]
        before = after = 0.0
        for deg in (self.din, self.dout):
            before = before + self._degree(self.n[gs], deg[gs]) + self._degree(self.n[hs], deg[hs])
            after = after + self._degree(n, deg[gs] + deg[hs])
        before = before + self._volume(self.links, self.lam_out, self.pairs) + self._volume(self.inside[gs], self.lam_in, self.n[gs] ** 2) + self._volume(self.inside[hs], self.lam_in, self.n[hs] ** 2)
        after = after + self._volume(self.links - mid, self.lam_out, self.pairs - 2 * self.n[gs] * self.n[hs]) + self._volume(self.inside[gs] + self.inside[hs] + mid, self.lam_in, n**2)
        return before - after

    def merge(self, w, g, h, loss=0.0):
        mid = self.between(g, h)
        self.n[w] = self.n[g] + self.n[h]
        self.inside[w] = self.inside[g] + self.inside[h] + mid
        self.din[w], self.dout[w] = self.din[g] + self.din[h], self.dout[g] + self.dout[h]
        for mine, theirs in ((self.out, self.into), (self.into, self.out)):
            for k in (g, h):
                for j, v in mine[k].items():
                    if j not in (g, h):
                        mine[w][j] = mine[w].get(j, 0.0) + v
            for j, v in mine[w].items():
                theirs[j].pop(g, None)
                theirs[j].pop(h, None)
                theirs[j][w] = v
        self.pairs -= 2 * self.n[g] * self.n[h]
        self.links -= mid


class AllFlows(Flows):
    """Degree-corrected block model in which every ordered pair of blocks has a volume of its own.

    A pair's cost sums up both blocks' volumes to and from all others, so it takes time in the number of blocks.
    """

    def __init__(self, rows: int, volumes: list[tuple[int, int, float]], lam_in: float | None = None, lam_out: float | None = None, degrees_from_origin: bool = False):
        super().__init__(rows, volumes, lam_in, lam_out, degrees_from_origin)
        self.active = set(range(rows))

    def _row(self, held: dict[int, float], at: dict[int, int]) -> np.ndarray:
        v = np.zeros(len(at))
        for j, e in held.items():
            if j in at:
                v[at[j]] = e
        return v

    def _pair(self, g: int, h: int) -> float:
        others = sorted(self.active - {g, h})
        at = {j: i for i, j in enumerate(others)}
        sizes, ng, nh = self.n[others], self.n[g], self.n[h]
        before = after = 0.0
        for side in (self.out, self.into):
            a, b = self._row(side[g], at), self._row(side[h], at)
            before += (self._volume(a, self.lam_out, ng * sizes) + self._volume(b, self.lam_out, nh * sizes)).sum()
            after += self._volume(a + b, self.lam_out, (ng + nh) * sizes).sum()
        there, back = self.out[g].get(h, 0.0), self.out[h].get(g, 0.0)
        before += self._volume(there, self.lam_out, ng * nh) + self._volume(back, self.lam_out, ng * nh)
        before += self._volume(self.inside[g], self.lam_in, ng**2) + self._volume(self.inside[h], self.lam_in, nh**2)
        after += self._volume(self.inside[g] + self.inside[h] + there + back, self.lam_in, (ng + nh) ** 2)
        for deg in (self.din, self.dout):
            before += self._degree(ng, deg[g]) + self._degree(nh, deg[h])
            after += self._degree(ng + nh, deg[g] + deg[h])
        return float(before - after)

    def cost(self, g, hs):
        return np.array([self._pair(int(a), int(b)) for a, b in zip(np.broadcast_to(g, np.shape(hs)), hs, strict=True)])

    def merge(self, w, g, h, loss=0.0):
        super().merge(w, g, h, loss)
        self.active = self.active - {g, h} | {w}
