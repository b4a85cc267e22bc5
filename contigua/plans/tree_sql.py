"""SQL that merges the cheapest adjacent pair again and again, to hold the merge kernel against.

A recursive query has one row for each run and merge. Its state is a list of nodes (leaves first, a new one with each merge),
a list of priced edges and, for each leaf, the node that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass


def _pairwise(a: str, b: str, of: str) -> str:
    """Sum over features of an expression in p and q, the values of both lists."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {of.replace('p!', 'z[1]').replace('q!', 'z[2]')}))"


def _joined(a: str, b: str, of: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: {of.replace('p!', 'z[1]').replace('q!', 'z[2]')})"


@dataclass(frozen=True)
class Rule:
    """SQL of a criterion: cost(g, h) of two nodes, and fields of the merged node; `w` is the run's list of constants."""

    constants: str = "[0.0]"
    first: str = "0.0"
    bayesian: bool = False
    means: bool = True
    chi: bool = False
    ward: bool = False
    median: bool = False
    gaussian: bool = False

    def x(self, g: str, h: str) -> str:
        if self.median:
            return _joined(f"{g}.x", f"{h}.x", "(p! + q!) / 2")
        if self.means:
            return _joined(f"{g}.x", f"{h}.x", f"(p! * {g}.n + q! * {h}.n) / ({g}.n + {h}.n)")
        return _joined(f"{g}.x", f"{h}.x", "p! + q!")

    def s(self, g: str, h: str) -> str:
        """Squares about the mean of both nodes together."""
        return _joined(f"list_zip({g}.s, {h}.s)", f"list_zip({g}.x, {h}.x)", f"p![1] + p![2] + {g}.n * {h}.n / ({g}.n + {h}.n) * (q![1] - q![2]) ** 2") if self.gaussian else f"{g}.s"

    def evidence(self, x: str, s: str, n: str) -> str:
        if self.gaussian:  # constants: features' prior means, then their prior scale
            k = f"(1.0 + floor({n} / 2))"
            each = f"lgamma({k}) + ln(q!.be) - {k} * ln(q!.be + p![2] / 2 + 0.01 * {n} / (2 * (0.01 + {n})) * (p![1] - q!.mu) ** 2) + 0.5 * ln(0.01) - 0.5 * ln(0.01 + {n}) - floor({n} / 2) * ln(2 * pi())"
            return _pairwise(f"list_zip({x}, {s})", "w", each)
        return f"(lgamma(len({x})::DOUBLE) + list_sum(list_transform({x}, lambda v: lgamma(v + 1.0))) - lgamma(list_sum({x}) + len({x})) + lgamma({n} + 1.0))"

    def cost(self, g: str, h: str) -> str:
        if self.bayesian:
            return f"({g}.lp + {h}.lp - {self.evidence(self.x(g, h), self.s(g, h), f'({g}.n + {h}.n)')})"
        if self.chi:
            gap = f"list_sum(list_transform(list_zip({g}.x, {h}.x, w), lambda z: z[3] * (z[1] / list_sum({g}.x) - z[2] / list_sum({h}.x)) ** 2))"
            return f"CASE WHEN list_sum({g}.x) = 0 OR list_sum({h}.x) = 0 THEN 0.0 ELSE {gap} END"
        d2 = _pairwise(f"{g}.x", f"{h}.x", "(p! - q!) ** 2")
        return f"({g}.n * {h}.n / ({g}.n + {h}.n) * {d2})" if self.ward else d2


RULES = {
    "ward": Rule(ward=True),
    "centroid": Rule(),
    "median": Rule(median=True),
    "chisq": Rule(means=False, chi=True, constants="(SELECT list(coalesce(floor(whole) / nullif(t, 0), 0) ORDER BY d) FROM (SELECT d, sum(v) AS t, sum(sum(v)) OVER () AS whole FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS d FROM leaves y WHERE y.run_key = leaves.run_key) GROUP BY d))"),
    "bayes_mom": Rule(means=False, bayesian=True),
    "bayes_dgmm": Rule(gaussian=True, bayesian=True, constants="(SELECT list({'mu': mu, 'be': 0.1 * whole} ORDER BY d) FROM (SELECT d, avg(v) AS mu, sum(var_pop(v)) OVER () AS whole FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS d FROM leaves y WHERE y.run_key = leaves.run_key) GROUP BY d))"),
}


def tree(method: str, leaves: str, edges: str | None = None) -> str:
    """CTEs `merges` (run_key, m, nn, l, r, cost, size, top, o) and `levels` (run_key, nn, k, level), of leaves (run_key, i, id, x).

    i numbers a run's leaves from 0; edges (run_key, u, v) join these numbers, u < v; without edges each leaf is joined to the next.
    """
    r = RULES[method]
    ends = edges or "SELECT run_key, i AS u, i + 1 AS v FROM leaves QUALIFY i + 1 < count(*) OVER (PARTITION BY run_key)"
    single = f"{{'n': 1.0::DOUBLE, 'x': x, 's': list_transform(x, lambda v: 0.0::DOUBLE), 'lp': 0.0::DOUBLE, 'o': [i]}}"
    first = r.evidence("one.x", "one.s", "one.n") if r.bayesian else "0.0::DOUBLE"
    full = f"list_transform(a, lambda one: {{'n': one.n, 'x': one.x, 's': one.s, 'lp': {first}, 'o': one.o}})"
    near = "list_reverse_sort(list_distinct(list_transform(list_filter(e, lambda z: (z.u IN (p.u, p.v)) <> (z.v IN (p.u, p.v))), lambda z: CASE WHEN z.u IN (p.u, p.v) THEN z.v ELSE z.u END)))"
    return f"""leaves AS ({leaves}),
    ends AS ({ends}),
    bare AS (SELECT run_key, {r.constants} AS w, list({single} ORDER BY i) AS a, count(*) AS nn, list(i ORDER BY i) AS top FROM leaves GROUP BY run_key),
    held AS (SELECT run_key, w, nn, top, {full} AS a FROM bare),
    priced AS (SELECT run_key, list({{'c': c, 'q': q, 'u': u, 'v': v}}) AS e FROM
        (SELECT run_key, u, v, row_number() OVER (PARTITION BY run_key ORDER BY u, v) AS q, {r.cost("g", "h")} AS c FROM (SELECT run_key, u, v, w, a[u + 1] AS g, a[v + 1] AS h FROM ends JOIN held USING (run_key))) GROUP BY run_key),
    merges AS (
        SELECT run_key, 0::BIGINT AS m, nn, w, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS cost, NULL::BIGINT AS size, NULL::BIGINT[] AS o, a, coalesce(e, []) AS e, top FROM held LEFT JOIN priced USING (run_key)
        UNION ALL
        SELECT run_key, m + 1, nn, w, p.u, p.v, p.c, made.n::BIGINT, made.o, list_append(a, made),
            list_concat(list_filter(e, lambda z: z.u NOT IN (p.u, p.v) AND z.v NOT IN (p.u, p.v)), list_transform(near, lambda j, k: {{'c': {r.cost("a[j + 1]", "made")}, 'q': 1000000000 + m * 1000000 + k, 'u': j, 'v': nn + m}})),
            list_transform(top, lambda z: CASE WHEN z IN (p.u, p.v) THEN nn + m ELSE z END)
        FROM (SELECT *, {near} AS near, {{'n': g.n + h.n, 'x': {r.x("g", "h")}, 's': {r.s("g", "h")}, 'lp': g.lp + h.lp - p.c, 'o': list_concat(g.o, h.o)}} AS made
            FROM (SELECT *, a[p.u + 1] AS g, a[p.v + 1] AS h FROM (SELECT *, list_min(e) AS p FROM merges WHERE len(e) > 0)))),
    levels AS (SELECT run_key, nn, nn - m AS k, {"-(start - done + lgamma(nn + 1.0) - (lgamma(nn::DOUBLE) - lgamma((nn - m)::DOUBLE) - lgamma(m + 1.0)) - lgamma(nn - m + 1.0))" if r.bayesian else "done"} AS level
        FROM (SELECT run_key, nn, m, coalesce(sum(cost) OVER (PARTITION BY run_key ORDER BY m), 0) AS done FROM merges) JOIN (SELECT run_key, list_sum(list_transform(a, lambda z: z.lp)) AS start FROM held) USING (run_key))"""


#: heights (run_key, m, height): slopes of the concave hull of the negated levels against the number of clusters.
HEIGHTS = """tops AS (SELECT run_key, nn, arg_min(k, (level, k)) AS top FROM levels GROUP BY run_key, nn),
    slopes AS (SELECT a.run_key, a.k AS i, b.k AS j, (a.level - b.level) / (b.k - a.k) AS slope FROM levels a JOIN levels b ON a.run_key = b.run_key AND a.k < b.k JOIN tops t ON t.run_key = a.run_key AND b.k <= t.top),
    hull AS (SELECT run_key, j - 1 AS k, min(steep) AS slope FROM (SELECT run_key, i, j, max(slope) OVER (PARTITION BY run_key, i ORDER BY j DESC) AS steep FROM slopes) GROUP BY run_key, j),
    heights AS (SELECT l.run_key, l.nn - l.k AS m, coalesce(h.slope, 0.0) AS height FROM levels l LEFT JOIN hull h ON h.run_key = l.run_key AND h.k = l.k WHERE l.k < l.nn)"""


def cuts(ks: str) -> str:
    """CTE `cuts` (run_key, asked, k, i, cl): clusters numbered by their first leaf; `ks` gives (run_key, asked, k)."""
    return f"""asked AS ({ks}),
    flat AS (SELECT run_key, asked, k, unnest(top) AS node, unnest(range(len(top))) AS i FROM merges JOIN asked USING (run_key) WHERE nn - m = k),
    cuts AS (SELECT run_key, asked, k, i, dense_rank() OVER (PARTITION BY run_key, asked ORDER BY head)::INTEGER AS cl FROM (SELECT *, min(i) OVER (PARTITION BY run_key, asked, node) AS head FROM flat))"""


CHAINS = "SELECT user_id AS run_key, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, [value] AS x FROM events"


def upto(*ks: int) -> str:
    return f"SELECT DISTINCT run_key, t.k AS asked, least(t.k, nn) AS k FROM merges, (VALUES {', '.join(f'({k})' for k in ks)}) t(k)"


BEST = "SELECT run_key, 0 AS asked, top AS k FROM tops"


def chains(method: str, rest: str, ks: str | None = None) -> str:
    """A query over the trees of all users' events: merges, levels, heights, tops and, with ks, cuts are at hand."""
    return f"WITH RECURSIVE {tree(method, CHAINS)}, {HEIGHTS}{', ' + cuts(ks) if ks else ''} {rest}"
