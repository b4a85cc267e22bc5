"""Methods by name, and the schemas of dendrograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Method:
    """A merge criterion with its parameters.

    approx: Bayesian ones order merges without the spanning-tree prior. halves: n / 2, D / 2 and the chi-square total are
    rounded down, as in the published results; False uses exact values.
    """

    name: str
    beta: float | None = None
    tau: float = 0.01
    kappa: float = 1.0
    mu: tuple[float, ...] | None = None
    lam: tuple[float, ...] | float | None = None
    approx: bool = False
    halves: bool = True

    @property
    def bayesian(self) -> bool:
        return self.name.startswith("bayes_")


METHODS = ("ward", "centroid", "median", "chisq", "bayes_mom", "bayes_dgmm", "bayes_dirichlet")


def method_of(method: object) -> Method:
    """A Method from its name, a function that makes one, or itself."""
    if callable(method) and not isinstance(method, Method):
        method = method()
    if isinstance(method, str) and method in METHODS:
        return Method(method)
    if isinstance(method, Method) and method.name in METHODS:
        return method
    raise ValueError("'method' not recognized")


@dataclass
class Dendrogram:
    """What a fit gives, for each run: tables that can be joined, cut and rolled up.

    leaves (run_key, leaf, id, place, x): leaf is the 0-based rank of the id, place its position from left to right.
    merges (run_key, m, left, right, cost, height, size, center): the m-th merge, m from 1, of nodes left < right; the
        merge makes node n - 1 + m, leaves being nodes 0 to n - 1.
    levels (run_key, m, k, level, prior_intra, prior_inter, prior_k): m = 0 is all leaves apart; level is the cumulated cost
        of classical methods and the negated log posterior of Bayesian ones.
    """

    leaves: DataFrame
    merges: DataFrame
    levels: DataFrame
    method: Method
