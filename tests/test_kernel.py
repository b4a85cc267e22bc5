import itertools

import numpy as np
import pytest

from contigua.operators.criteria import CRITERIA, Flows, Gaussian
from contigua.operators.kernel import canonical, cut_labels, greedy, heights, leaf_order, log_trees
from contigua.types import Method, method_of


def brute(n, edges, state, first_cost):
    """Merges by looking at all adjacent pairs each time; ties go to the pair that arose first."""
    near = {tuple(sorted(e)) for e in edges}
    born = {e: k for k, e in enumerate(sorted(near))}
    cost = {e: first_cost(e) for e in near}
    out, seq = [], len(near)
    for m in range(n - 1):
        g, h = min(near, key=lambda e: (cost[e], born[e]))
        w = n + m
        out.append((g, h))
        state.merge(w, g, h, cost[(g, h)])
        others = {a if b in (g, h) else b for a, b in near if (a in (g, h)) != (b in (g, h))}
        near = {e for e in near if g not in e and h not in e}
        for j in sorted(others, reverse=True):
            near.add((j, w))
            cost[(j, w)] = float(state.cost(w, np.array([j]))[0])
            born[(j, w)] = seq
            seq += 1
    return np.array(out)


def grid(w):
    g = np.arange(w * w).reshape(w, w)
    return np.concatenate([np.stack([g[:, :-1].ravel(), g[:, 1:].ravel()], 1), np.stack([g[:-1].ravel(), g[1:].ravel()], 1)])


@pytest.mark.parametrize("name", ["ward", "centroid", "median", "chisq"])
@pytest.mark.parametrize("seed", range(4))
def test_greedy_matches_brute_force_with_ties(name, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 4, size=(25, 2)).astype(float)  # many equal costs
    edges = grid(5)
    state = CRITERIA[name](x, Method(name))
    want = brute(25, edges.tolist(), state, lambda e: float(state.cost(e[0], np.array([e[1]]))[0]))
    got = greedy(25, edges[::-1, ::-1], CRITERIA[name](x, Method(name)))
    assert (got.pairs == want).all()


@pytest.mark.parametrize("name", ["ward", "median"])
def test_hub_matches_brute_force(name):
    """A row beside all others, whose neighbours are held anew at each merge with it."""
    x = np.random.default_rng(1).integers(1, 9, size=(60, 2)).astype(float)
    edges = np.concatenate([np.stack([np.zeros(59, int), np.arange(1, 60)], 1), np.stack([np.arange(1, 59), np.arange(2, 60)], 1)[::3]])
    state = CRITERIA[name](x, Method(name))
    want = brute(60, edges.tolist(), state, lambda e: float(state.cost(e[0], np.array([e[1]]))[0]))
    assert (greedy(60, edges, CRITERIA[name](x, Method(name))).pairs == want).all()


@pytest.mark.parametrize("name", ["bayes_mom", "bayes_dgmm", "bayes_dirichlet"])
def test_bayesian_chain_matches_brute_force(name):
    rng = np.random.default_rng(3)
    x = rng.dirichlet([3, 2, 4], size=15)
    if name == "bayes_mom":
        x = rng.poisson(5, size=(15, 3)).astype(float)
    edges = np.stack([np.arange(14), np.arange(1, 15)], 1)
    state = CRITERIA[name](x, Method(name))
    want = brute(15, edges.tolist(), state, lambda e: float(state.cost(e[0], np.array([e[1]]))[0]))
    assert (greedy(15, edges, CRITERIA[name](x, Method(name)), True).pairs == want).all()


def test_ward_on_complete_graph_has_total_as_last_level():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 4))
    r = greedy(20, np.array(list(itertools.combinations(range(20), 2))), CRITERIA["ward"](x, Method("ward")))
    assert np.isclose(r.level[-1], ((x - x.mean(0)) ** 2).sum()) and np.allclose(r.center[-1], x.mean(0))
    assert (np.diff(heights(r.level)) >= -1e-12).all()


def test_priors_match_definitions():
    rng = np.random.default_rng(5)
    x, edges = rng.normal(size=(36, 2)), canonical(grid(6))
    for approx in (False, True):
        r = greedy(36, edges, Gaussian(x, Method("bayes_dgmm")), True, approx)
        for k in range(1, 37):
            cl = cut_labels(36, r.pairs, k)
            inside = 0.0
            for c in range(1, k + 1):
                m = np.flatnonzero(cl == c).tolist()
                inside += log_trees(len(m), [(m.index(a), m.index(b)) for a, b in edges.tolist() if cl[a] == c == cl[b]])
            assert abs(inside - r.prior_intra[36 - k]) < 1e-8


def test_spanning_trees_of_known_graphs():
    for n in (2, 3, 7):
        assert abs(log_trees(n, [(i, i + 1) for i in range(n - 1)])) < 1e-12
        assert np.isclose(log_trees(n, list(itertools.combinations(range(n), 2))), (n - 2) * np.log(n))
    assert log_trees(1, []) == 0 and log_trees(3, [(0, 1)]) == -np.inf
    assert np.isclose(log_trees(7, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]), np.log(9))


def test_spanning_trees_match_determinants():
    rng = np.random.default_rng(2)
    for n, p in ((12, 0.4), (40, 0.15), (90, 0.9), (60, 0.05)):
        e = [(i, j) for i in range(n) for j in range(i) if rng.random() < p]
        w = rng.uniform(0.5, 3, len(e)).tolist()
        lap = np.zeros((n, n))
        for (a, b), v in zip(e, w):
            lap[[a, b], [a, b]] += v
            lap[[a, b], [b, a]] -= v
        sign, want = np.linalg.slogdet(lap[1:, 1:])
        parts, got = len(e) and connected_parts(n, e), log_trees(n, e, w)
        assert got == -np.inf if parts > 1 else abs(got - want) < 1e-8
    w = 30  # a product formula holds for grids
    s = 4 * np.sin(np.pi * np.arange(w) / 2 / w) ** 2
    both = (s[:, None] + s[None]).ravel()[1:]
    assert abs(log_trees(w * w, grid(w).tolist()) - (np.log(both).sum() - np.log(w * w))) < 1e-7


def connected_parts(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return len(set(label))


@pytest.mark.parametrize("name", ["bayes_mom", "bayes_dgmm"])
def test_bayesian_grid_matches_dense_counts(name):
    """Merges ordered by costs less the trees of the cut, each count a determinant of its own."""
    rng = np.random.default_rng(7)
    x = rng.poisson(5, size=(25, 3)).astype(float) + np.repeat([0, 6, 0, 6, 2], 5)[:, None]
    edges = np.concatenate([grid(5), [[0, 6], [12, 18], [3, 7]]])
    inner = lambda nodes: [(sorted(nodes).index(a), sorted(nodes).index(b)) for a, b in edges.tolist() if a in nodes and b in nodes]
    tau = lambda nodes: log_trees(len(nodes), inner(nodes))
    state, members, near, cost = CRITERIA[name](x, Method(name)), {i: {i} for i in range(25)}, set(map(tuple, np.sort(edges, axis=1).tolist())), {}
    price = lambda a, b: float(state.cost(a, np.array([b]))[0])
    cut = lambda a, b: sum((u in members[a]) == (v in members[b]) and (u in members[b]) == (v in members[a]) and u in members[a] | members[b] and v in members[a] | members[b] and (u in members[a]) != (v in members[a]) for u, v in edges.tolist())
    cost = {e: (price(*e), price(*e)) for e in near}
    pairs, intra = [], [0.0]
    for m in range(24):
        g, h = min(near, key=lambda e: cost[e][0])
        w = 25 + m
        pairs.append((g, h))
        members[w] = members[g] | members[h]
        intra.append(intra[-1] + tau(members[w]) - tau(members[g]) - tau(members[h]))
        state.merge(w, g, h, cost[g, h][1])
        others = {a if b in (g, h) else b for a, b in near if (a in (g, h)) != (b in (g, h))}
        near = {e for e in near if g not in e and h not in e} | {(j, w) for j in others}
        for j in others:
            c = price(w, j)
            cost[j, w] = c - (tau(members[w] | members[j]) - tau(members[w]) - tau(members[j])) + np.log(cut(w, j)), c
    got = greedy(25, edges, CRITERIA[name](x, Method(name)), True)
    assert got.pairs.tolist() == [list(p) for p in pairs]
    assert np.allclose(got.prior_intra, intra, atol=1e-9)


def test_heights_pool_inversions():
    assert np.allclose(heights(np.cumsum([0, 1, 2, 3, 5])), [1, 2, 3, 5])
    assert np.allclose(heights(np.cumsum([0, 1, 5, 2, 8])), [1, 3.5, 3.5, 8])
    assert np.allclose(heights(np.array([5.0, 3.0, 1.0, 4.0])), [0, 0, 3])


def test_order_and_labels():
    pairs = np.array([[0, 1], [2, 3], [4, 5]])
    assert leaf_order(4, pairs).tolist() == [0, 1, 2, 3]
    assert cut_labels(4, pairs, 2).tolist() == [1, 1, 2, 2] and cut_labels(4, pairs, 4).tolist() == [1, 2, 3, 4]


def test_small_and_broken_runs():
    ward = lambda x: CRITERIA["ward"](np.array(x, float), Method("ward"))
    assert len(greedy(1, np.zeros((0, 2), int), ward([[1]])).pairs) == 0
    assert greedy(2, np.array([[1, 0], [0, 1], [0, 0]]), ward([[1], [3]])).level.tolist() == [0, 2]
    with pytest.raises(ValueError, match="not connected"):
        greedy(3, np.array([[0, 1]]), ward([[1], [2], [3]]))
    with pytest.raises(ValueError):
        CRITERIA["bayes_dirichlet"](np.array([[0.0, 1.0]]), Method("bayes_dirichlet"))
    with pytest.raises(ValueError, match="not recognized"):
        method_of("wards")
    assert method_of(lambda: Method("chisq")).name == "chisq"
    x = np.array([[0.0, 0.0], [1.0, 2.0]])
    assert greedy(2, np.array([[0, 1]]), CRITERIA["chisq"](x, Method("chisq"))).cost[0] == 0


def test_flows_cost_falls_by_what_a_merge_changes():
    volumes = [(0, 1, 5.0), (1, 0, 4.0), (2, 3, 7.0), (3, 2, 6.0), (0, 2, 1.0), (1, 1, 2.0)]
    edges = np.array([[0, 1], [1, 2], [2, 3]])
    r = greedy(4, edges, Flows(4, volumes), True)
    assert {tuple(p) for p in r.pairs[:2].tolist()} == {(0, 1), (2, 3)}
    a, b = Flows(4, volumes), Flows(4, volumes)
    assert np.isclose(a.cost(0, np.array([1]))[0], b.cost(1, np.array([0]))[0])
    a.merge(4, 0, 1)
    assert a.links == 1 + 13 and a.inside[4] == 11 and a.pairs == 10 and a.out[4] == {2: 1.0}


def test_planted_segments_are_found():
    rng = np.random.default_rng(6)
    truth = np.repeat(np.arange(20), 50)
    x = rng.uniform(size=(20, 8))[truth] * 20 + rng.normal(size=(1000, 8))
    chain = np.stack([np.arange(999), np.arange(1, 1000)], 1)
    for name, v in (("bayes_dgmm", x), ("bayes_mom", rng.poisson(np.abs(rng.uniform(size=(20, 8))[truth] * 20)).astype(float))):
        r = greedy(1000, chain, CRITERIA[name](v, Method(name)), True)
        cl = cut_labels(1000, r.pairs, 20)
        wrong = sum((cl[truth == t] != np.bincount(cl[truth == t]).argmax()).sum() for t in range(20))
        assert wrong <= 10
