"""Fitting dendrograms: independent runs in parallel, each in one task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.operators.criteria import CRITERIA, AllFlows, Flows
from contigua.operators.kernel import Merged, greedy, heights, leaf_order
from contigua.plans.shared import Kept
from contigua.types import Dendrogram, Method, method_of

#: One table from the kernel: rows with `id` are leaves (m null), the others levels (m from 0) with their merge (m from 1).
RESULT = "run_key bigint, id bigint, leaf int, place int, x array<double>, m int, k int, left int, right int, cost double, height double, size bigint, center array<double>, level double, prior_intra double, prior_inter double, prior_k double"
#: Most rows that one run can have: its nodes, nearly twice as many, are numbered with 32 bits. A run is sequential and in one task.
MOST_ROWS = 2**30
#: Rows of results that are made together.
BATCH = 40_000


ARROW = pa.schema(
    [("run_key", pa.int64()), ("id", pa.int64()), ("leaf", pa.int32()), ("place", pa.int32()), ("x", pa.list_(pa.float64())), ("m", pa.int32()), ("k", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("cost", pa.float64()), ("height", pa.float64()), ("size", pa.int64()), ("center", pa.list_(pa.float64())), ("level", pa.float64()), ("prior_intra", pa.float64()), ("prior_inter", pa.float64()), ("prior_k", pa.float64())]
)


@dataclass
class _Run:
    key: int
    ids: np.ndarray
    x: np.ndarray | None
    merged: Merged
    bayesian: bool

    @cached_property
    def level(self) -> np.ndarray:
        return -self.merged.level if self.bayesian else self.merged.level

    @cached_property
    def height(self) -> np.ndarray:
        return heights(self.level)

    @cached_property
    def place(self) -> np.ndarray:
        place = np.empty(len(self.ids), int)
        place[leaf_order(len(self.ids), self.merged.pairs)] = np.arange(len(self.ids))
        return place

    def columns(self, lo: int, hi: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Values and validity of each column, in some of the rows; these are leaves, then levels. Of lists, what those have that aren't null."""
        n, r = len(self.ids), self.merged
        row = np.arange(lo, hi)
        leaf = row < n
        m, every, prior = row - n * ~leaf, np.ones(hi - lo, bool), ~leaf & self.bayesian
        merge = ~leaf & (m > 0)
        late = lambda v: v[m - 1] if n > 1 else np.zeros(hi - lo)
        lists = lambda v, ok: (np.zeros((0, 0)), ~every) if self.x is None else (v, ok)
        return {
            "run_key": (np.full(hi - lo, self.key), every), "id": (self.ids[m], leaf), "leaf": (m, leaf), "place": (self.place[m], leaf), "m": (m, ~leaf), "k": (n - m, ~leaf),
            "left": (late(r.pairs[:, 0]), merge), "right": (late(r.pairs[:, 1]), merge), "cost": (late(r.cost), merge), "height": (late(self.height), merge), "size": (late(r.size), merge),
            "level": (self.level[m], ~leaf), "prior_intra": (r.prior_intra[m], prior), "prior_inter": (r.prior_inter[m], prior), "prior_k": (r.prior_k[m], prior),
            "x": lists(self.x if self.x is None else self.x[m[leaf]], leaf), "center": lists(r.center[m[merge] - 1], merge),
        }


def _batch(parts: list[dict[str, tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    out = []
    for f in ARROW:
        each = [p[f.name] for p in parts]
        ok = np.concatenate([valid for _, valid in each])
        if pa.types.is_list(f.type):
            ends = np.cumsum(np.concatenate([[0], *[valid * v.shape[1] for v, valid in each]]))
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([v.ravel() for v, _ in each])), mask=pa.array(~ok)))
        else:
            out.append(pa.array(np.concatenate([v for v, _ in each]).astype(f.type.to_pandas_dtype()), f.type, mask=~ok))
    return pa.record_batch(out, schema=ARROW)


def _batches(runs: list[_Run]) -> Iterator[pa.RecordBatch]:
    """All rows of runs, those of a long run in several batches."""
    parts, rows = [], 0
    for r in runs:
        n = 2 * len(r.ids)
        for lo in range(0, n, BATCH):
            hi = min(lo + BATCH, n)
            if parts and rows + hi - lo > BATCH:
                yield _batch(parts)
                parts, rows = [], 0
            parts.append(r.columns(lo, hi))
            rows += hi - lo
    if parts:
        yield _batch(parts)


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Feature lists of equal length as a matrix."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if not len(x):
        return np.zeros((0, 1))
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    if x.null_count or len(flat) % len(x) or (np.asarray(x.value_lengths()) != len(flat) // len(x)).any() or not np.isfinite(flat).all():
        raise ValueError("Some regions have missing values and missing values are not allowed.")
    return flat.reshape(len(x), -1)


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each id, in the rows' order."""
    if len(ids) > MOST_ROWS:
        raise ValueError(f"a run has {len(ids)} rows; its nodes can't be numbered beyond {MOST_ROWS}")
    first = np.sort(np.unique(ids, return_index=True)[1])
    return (ids, x) if len(first) == len(ids) else (ids[first], x[first])


def _run(key: int, ids: np.ndarray, x: np.ndarray, edges: np.ndarray, method: Method) -> _Run:
    return _Run(key, ids, x, greedy(len(ids), edges, CRITERIA[method.name](x, method), method.bayesian, method.approx), method.bayesian)


def _each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of batches that are ordered by run_key, parted where another run begins."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("run_key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(keys[lo]), b.slice(lo, hi - lo)


def each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one run after another, of batches that are ordered by run_key."""
    for key, parts in groupby(_each_part(batches), itemgetter(0)):
        yield key, pa.Table.from_batches([b for _, b in parts])


def _dendrogram(result: DataFrame, method: Method) -> Dendrogram:
    # the kernel's result is written once: its three views don't fit again
    kept = Kept(result, "dendrogram").df
    return Dendrogram(
        leaves=kept.where("m is null").select("run_key", "leaf", "id", "place", "x"),
        merges=kept.where("m > 0").select("run_key", "m", "left", "right", "cost", "height", "size", "center"),
        levels=kept.where("m is not null").select("run_key", "m", "k", "level", "prior_intra", "prior_inter", "prior_k"),
        method=method,
    )


def by_run(df: DataFrame) -> DataFrame:
    """Rows of a run together. The number of partitions is set, as few small rows mean much work here and must not be joined in one task."""
    spark = df.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(wide, "run_key")


def fit_chain(features: DataFrame, method: object = "ward") -> Dendrogram:
    """Rows (run_key, id, ord, x) of each run in order of (ord, id), each adjacent to the next: no edge table, one shuffle."""
    how = method_of(method)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, rows = [], 0
        for key, t in each_run(batches):
            ids, x = _once(t["id"].to_numpy(), _matrix(t["x"]))
            steps = np.arange(len(ids) - 1)
            done.append(_run(key, ids, x, np.stack([steps, steps + 1], axis=1), how))
            rows += len(ids)
            if rows > 20_000:
                yield from _batches(done)
                done, rows = [], 0
        yield from _batches(done)

    ordered = by_run(features.select("run_key", "id", "ord", "x")).sortWithinPartitions("run_key", "ord", "id").select("run_key", "id", "x")
    return _dendrogram(ordered.mapInArrow(fit, RESULT), how)


def _dense(e: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Edges between ids as edges between their ranks; ends that are no ids raise an error."""
    if not len(e):
        return np.zeros((0, 2), int)
    at = np.searchsorted(ids, e)
    if (at >= len(ids)).any() or (ids[np.minimum(at, len(ids) - 1)] != e).any():
        raise ValueError("an edge has an end without features")
    return at


def _graph_of(parts: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and edges between the ids' ranks, of a run's rows in order of id and then its edges. No batch is kept."""
    rows: list[np.ndarray] = []
    x: list[np.ndarray] = []
    edges = [np.zeros((0, 2), np.int32)]
    ids: np.ndarray | None = None
    for p in parts:
        n = int(np.searchsorted(p["kind"].to_numpy(), 1))
        if n:
            rows.append(p["id"].slice(0, n).to_numpy(zero_copy_only=False).copy())
            x.append(_matrix(p["x"].slice(0, n)))
        if n < p.num_rows:
            if not rows:
                raise ValueError("an edge has an end without features")
            if ids is None:  # all rows have come
                ids = np.unique(np.concatenate(rows))
            ends = np.stack([p[c].slice(n).to_numpy(zero_copy_only=False) for c in ("id", "dst")], axis=1)
            edges.append(_dense(ends, ids).astype(np.int32))
    if len({v.shape[1] for v in x}) > 1:
        raise ValueError("Some regions have missing values and missing values are not allowed.")
    return *_once(np.concatenate(rows), np.concatenate(x)), np.concatenate(edges)


def fit_graph(features: DataFrame, edges: DataFrame, method: object = "ward") -> Dendrogram:
    """Rows (run_key, id, x) under the contiguity graph (run_key, src, dst), which may be repeated, reversed or have loops."""
    how = method_of(method)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in groupby(_each_part(batches), itemgetter(0)):
            yield from _batches([_run(key, *_graph_of(p for _, p in parts), how)])

    rows = features.select("run_key", F.lit(0).alias("kind"), "id", F.lit(None).cast("bigint").alias("dst"), "x")
    pairs = edges.select("run_key", F.lit(1).alias("kind"), F.col("src").alias("id"), "dst", F.lit(None).cast(features.schema["x"].dataType).alias("x"))
    return _dendrogram(by_run(rows.unionByName(pairs)).sortWithinPartitions("run_key", "kind", "id", "dst").mapInArrow(fit, RESULT), how)


def _flow_tables(zones: DataFrame, edges: DataFrame, flows: DataFrame) -> DataFrame:
    """Zones, edges and flows, those of equal ends added, as one table."""
    tag = lambda df, k, a, b, v: df.select("run_key", F.lit(k).alias("kind"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), v.cast("double").alias("v"))
    none = F.lit(None)
    return (
        tag(zones, 0, F.col("id"), none, none)
        .unionByName(tag(edges, 1, F.col("src"), F.col("dst"), none))
        .unionByName(tag(flows.groupBy("run_key", "o", "d").agg(F.sum("vol").alias("vol")), 2, F.col("o"), F.col("d"), F.col("vol")))
    )


def _flow_state(t: pa.Table, full: bool, lam_in: float | None, lam_out: float | None, degrees_from_origin: bool) -> tuple[np.ndarray, np.ndarray, Flows]:
    """Ids, edges between their ranks, and the criterion's state."""
    kind, a, b = (t[c].to_numpy() for c in ("kind", "a", "b"))
    ids = np.unique(a[kind == 0].astype(int))
    ends = np.stack([a[kind == 1], b[kind == 1]], axis=1).astype(int)
    w = np.stack([a[kind == 2], b[kind == 2]], axis=1).astype(int)
    v = t["v"].to_numpy()[kind == 2]
    known = np.isin(w, ids).all(axis=1)
    order = np.lexsort((w[known, 1], w[known, 0]))
    at, v = np.searchsorted(ids, w[known][order]), v[known][order]
    state = (AllFlows if full else Flows)(len(ids), [(int(o), int(d), float(u)) for (o, d), u in zip(at, v, strict=True)], lam_in, lam_out, degrees_from_origin)
    return ids, _dense(ends, ids), state


def fit_flows(zones: DataFrame, edges: DataFrame, flows: DataFrame, *, full: bool = False, lam_in: float | None = None, lam_out: float | None = None, approx: bool = False, degrees_from_origin: bool = False) -> Dendrogram:
    """Zones (run_key, id) under a contiguity graph, merged by how like their flows (run_key, o, d, vol) are.

    Volumes between blocks have one expectation in common, or, with full, each ordered pair of blocks its own. Flows with an
    end that is no zone are dropped, those of equal ends added. degrees_from_origin counts arrivals at the origin too, as the
    published program does.
    """
    how = Method("bayes_mom", approx=approx)

    def fit(t: pa.Table) -> pa.Table:
        ids, ends, state = _flow_state(t, full, lam_in, lam_out, degrees_from_origin)
        merged = greedy(len(ids), ends, state, True, approx)
        return pa.Table.from_batches(_batches([_Run(t["run_key"][0].as_py(), ids, None, merged, True)]))

    return _dendrogram(by_run(_flow_tables(zones, edges, flows)).groupBy("run_key").applyInArrow(fit, RESULT), how)


def flow_costs(zones: DataFrame, edges: DataFrame, flows: DataFrame, *, full: bool = False, lam_in: float | None = None, lam_out: float | None = None, degrees_from_origin: bool = False) -> DataFrame:
    """(run_key, src, dst, cost): what merging each adjacent pair of zones costs by their flows, before any merge."""

    def price(t: pa.Table) -> pa.Table:
        ids, ends, state = _flow_state(t, full, lam_in, lam_out, degrees_from_origin)
        cost = state.cost(ends[:, 0], ends[:, 1]) if len(ends) else np.zeros(0)
        return pa.table({"run_key": np.full(len(ends), t["run_key"][0].as_py()), "src": ids[ends[:, 0]], "dst": ids[ends[:, 1]], "cost": cost})

    return by_run(_flow_tables(zones, edges, flows)).groupBy("run_key").applyInArrow(price, "run_key bigint, src bigint, dst bigint, cost double")
