"""Cutting, ordering, collapsing and rolling up dendrograms, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.operators.fit import by_run, each_run
from contigua.operators.kernel import cut_labels, leaf_order
from contigua.types import Dendrogram


def _packed(tree: Dendrogram) -> DataFrame:
    """One row for each leaf and merge of a run, small enough for the task that made them."""
    leaves = tree.leaves.select("run_key", F.col("leaf").alias("i"), "id", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("double").alias("height"))
    merges = tree.merges.select("run_key", F.col("m").alias("i"), F.lit(None).cast("bigint").alias("id"), F.col("left").alias("a"), F.col("right").alias("b"), "height")
    return by_run(leaves.unionByName(merges))


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    leaf = pdf["a"].isna()
    ids = pdf[leaf].sort_values("i")["id"].to_numpy(int)
    merges = pdf[~leaf].sort_values("i")
    return ids, merges[["a", "b"]].to_numpy(int).reshape(-1, 2), merges["height"].to_numpy(float)


def cut(tree: Dendrogram, k: int | list[int] | None = None, h: float | list[float] | None = None) -> DataFrame:
    """(run_key, cut, k, id, cl): cluster numbers from 1, by first leaf, for each k or, without k, each height h.

    With h, k is 1 + the merges whose height is above h. k beyond a run's rows means all rows apart. `cut` is the k or h asked for.
    """
    if k is None and h is None:
        raise ValueError("At least one of k or h must be specified, k overrides h if both are given.")
    asked = [float(v) for v in (k if isinstance(k, list) else [k] if k is not None else h if isinstance(h, list) else [h])]
    if k is not None and min(asked) < 1:
        raise ValueError("k must be at least 1")
    by_k = k is not None

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_run(batches):
            ids, pairs, height = arrays_of(t)
            n = len(ids)
            for v in asked:
                kk = min(int(v), n) if by_k else n - int(np.argmax(np.append(height, np.inf) > v))
                yield pa.record_batch({"run_key": np.full(n, key), "cut": np.full(n, v), "k": np.full(n, kk, np.int32), "id": ids, "cl": cut_labels(n, pairs, kk).astype(np.int32)})

    return in_order(tree).mapInArrow(label, "run_key bigint, cut double, k int, id bigint, cl int")


def in_order(tree: Dendrogram) -> DataFrame:
    """Runs one after another, leaves before merges."""
    return _packed(tree).sortWithinPartitions("run_key", F.col("a").isNotNull(), "i")


def arrays_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = t["a"].null_count
    merges = t.slice(n)
    return t["id"].slice(0, n).to_numpy().astype(int), np.stack([merges[c].to_numpy() for c in "ab"], axis=1).astype(int).reshape(-1, 2), merges["height"].to_numpy()


def best_k(tree: Dendrogram) -> DataFrame:
    """(run_key, k): the number of clusters with the greatest posterior; of several the largest."""
    return tree.levels.groupBy("run_key").agg(F.min(F.struct("level", "m", "k")).alias("b")).select("run_key", F.col("b.k").alias("k"))


def cut_best(tree: Dendrogram) -> DataFrame:
    """(run_key, k, id, cl): each run cut at its own best number of clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, pairs, _ = _unpacked(pdf)
        k = int(pdf["best"].iloc[0])
        return pd.DataFrame({"run_key": pdf["run_key"].iloc[0], "k": k, "id": ids, "cl": cut_labels(len(ids), pairs, k)})

    return _packed(tree).join(best_k(tree).withColumnRenamed("k", "best"), "run_key").groupBy("run_key").applyInPandas(run, "run_key bigint, k int, id bigint, cl int")


def profiles(tree: Dendrogram, labels: DataFrame) -> DataFrame:
    """(run_key, k, cl, n, mean, sum): prototypes of clusters as mean and as sum of their members' features."""
    each = labels.join(tree.leaves.select("run_key", "id", "x"), ["run_key", "id"]).select("run_key", "k", "cl", "id", F.posexplode("x").alias("d", "v"))
    by = each.groupBy("run_key", "k", "cl", "d").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    rows = by.groupBy("run_key", "k", "cl").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "s"))).alias("v"))
    return rows.select("run_key", "k", "cl", "n", F.transform("v", lambda t: t["s"] / F.col("n")).alias("mean"), F.transform("v", lambda t: t["s"]).alias("sum"))


def signed_merges(tree: Dendrogram) -> DataFrame:
    """(run_key, m, a, b, height, center): merges with leaves as -1, -2, ... and earlier merges as 1, 2, ..."""
    n = tree.leaves.groupBy("run_key").agg(F.count("*").cast("int").alias("n"))
    code = lambda c: F.when(F.col(c) < F.col("n"), -(F.col(c) + 1)).otherwise(F.col(c) - F.col("n") + 1)
    return tree.merges.join(n, "run_key").select("run_key", "m", code("left").alias("a"), code("right").alias("b"), "height", "center")


def collapse(tree: Dendrogram, leafs: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """The top of each tree: (merges (run_key, m, a, b, height), members (run_key, branch, id)).

    The last leafs - 1 merges are kept and numbered anew; what hangs below them becomes branches 1 to `leafs`, written -1 to
    -leafs, first those on left sides. Smaller trees stay as they are. leafs None: each run's best number of clusters.
    """
    if leafs is not None and leafs < 1:
        raise ValueError("leafs must be at least 1")
    rows = _packed(tree).withColumn("leafs", F.lit(leafs)) if leafs else by_run(_packed(tree).join(best_k(tree).withColumnRenamed("k", "leafs"), "run_key"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, pairs, height = _unpacked(pdf)
        n, leafs = len(ids), int(pdf["leafs"].iloc[0])
        cutoff = max(0, n - leafs)  # merges below become part of branches
        top = np.arange(2 * n - 1)
        for m in range(cutoff):
            top[pairs[m]] = n + m
        for i in range(2 * n - 2, -1, -1):
            top[i] = i if top[i] == i else top[top[i]]
        kept = pairs[cutoff:]
        flat = kept.T.ravel()
        hung = flat[flat < n + cutoff] if len(kept) else np.array([int(top[0])])
        branch = {int(node): i + 1 for i, node in enumerate(hung)} if n > leafs else {i: i + 1 for i in range(n)}
        code = lambda v: -branch[v] if v < n + cutoff else v - n - cutoff + 1
        a = pd.DataFrame({"m": np.arange(1, len(kept) + 1), "a": [code(int(v)) for v in kept[:, 0]], "b": [code(int(v)) for v in kept[:, 1]], "height": height[cutoff:]})
        b = pd.DataFrame({"branch": [branch[int(t)] for t in top[:n]], "id": ids})
        out = pd.concat([a, b], ignore_index=True)
        for c in ("m", "a", "b", "branch"):
            out[c] = out.get(c, pd.Series(dtype="float")).astype("Int32")
        out["id"] = out["id"].astype("Int64")
        out.insert(0, "run_key", pdf["run_key"].iloc[0])
        return out[["run_key", "m", "a", "b", "height", "branch", "id"]]

    both = rows.groupBy("run_key").applyInPandas(run, "run_key bigint, m int, a int, b int, height double, branch int, id bigint")
    return both.where("m is not null").select("run_key", "m", "a", "b", "height"), both.where("branch is not null").select("run_key", "branch", "id")


def front(tree: Dendrogram, most: float | None = None) -> DataFrame:
    """(run_key, k, gain, x, xend, share): numbers of clusters that are best for some weight, with the weights from xend to x.

    gain is the negated level. `most` keeps those with xend below it, if at least three are.
    """
    levels = tree.levels.join(best_k(tree).withColumnRenamed("k", "top"), "run_key").where(F.col("k") <= F.col("top"))
    # the slope between k and k + 1 clusters is the height of the merge that leads to k
    slope = tree.merges.select("run_key", "m", "height")
    rows = levels.join(slope, ["run_key", "m"], "left").select("run_key", "k", (-F.col("level")).alias("gain"), F.coalesce("height", F.lit(0.0)).alias("xend"))
    first = rows.groupBy("run_key", "xend").agg(F.min(F.struct("k", "gain")).alias("f")).select("run_key", "f.k", "f.gain", "xend")
    if most is not None:
        few = Window.partitionBy("run_key")
        first = first.withColumn("below", F.count_if(F.col("xend") < most).over(few))
        first = first.withColumn("below", F.when(F.col("below") > 2, F.col("below")).otherwise(F.raise_error(F.lit("the weight is too small, no front to show")).cast("bigint"))).where((F.col("xend") < most) & (F.col("below") > 2)).drop("below")
    w = Window.partitionBy("run_key").orderBy("k")
    x = F.coalesce(F.lag("xend").over(w), F.max("xend").over(Window.partitionBy("run_key")) * 1.05)
    out = first.withColumn("x", x)
    whole = F.first("x").over(w)
    return out.withColumn("share", F.when(whole > 0, (F.col("x") - F.col("xend")) / whole).otherwise(1.0)).select("run_key", "k", "gain", "x", "xend", "share")


def segments(tree: Dendrogram) -> DataFrame:
    """(run_key, m, x, y, xend, yend): the lines of the drawn dendrogram, three for each merge; leaves stand at 1, 2, ... and height 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = pdf["a"].isna()
        n = int(leaf.sum())
        place = pdf[leaf].sort_values("i")["id"].to_numpy(float) + 1
        merges = pdf[~leaf].sort_values("i")
        pairs, height = merges[["a", "b"]].to_numpy(int).reshape(-1, 2), merges["height"].to_numpy(float)
        x, y = np.concatenate([place, np.zeros(n - 1)]), np.concatenate([np.zeros(n), height])
        lines = []
        for m, (a, b) in enumerate(pairs):
            x[n + m] = (x[a] + x[b]) / 2
            t = y[n + m]
            lines += [(m + 1, x[a], t, x[b], t), (m + 1, x[a], y[a], x[a], t), (m + 1, x[b], y[b], x[b], t)]
        out = pd.DataFrame(lines, columns=["m", "x", "y", "xend", "yend"])
        out.insert(0, "run_key", pdf["run_key"].iloc[0])
        return out

    placed = Dendrogram(tree.leaves.withColumn("id", F.col("place").cast("bigint")), tree.merges, tree.levels, tree.method)
    return _packed(placed).groupBy("run_key").applyInPandas(run, "run_key bigint, m int, x double, y double, xend double, yend double")


def drawing(tree: Dendrogram, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """What a plot of the top of each tree shows: (lines (run_key, m, x, y, xend, yend), branches (run_key, branch, x, size)).

    Bayesian trees are shown from their best number of clusters, others from `most` branches; branches stand at 1, 2, ...
    """
    merges, members = collapse(tree, None if tree.method.bayesian else most)
    sizes = members.groupBy("run_key", "branch").agg(F.count("*").alias("size"))
    n = sizes.groupBy("run_key").agg(F.count("*").cast("int").alias("n"))
    node = lambda c: F.when(F.col(c) < 0, -F.col(c) - 1).otherwise(F.col(c) + F.col("n") - 1)
    top = merges.join(n, "run_key").select("run_key", "m", node("a").cast("int").alias("left"), node("b").cast("int").alias("right"), "height")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_run(batches):
            ids, pairs, _ = arrays_of(t)
            at = np.empty(len(ids), int)
            at[leaf_order(len(ids), pairs)] = np.arange(len(ids))
            yield pa.record_batch({"run_key": np.full(len(ids), key), "branch": (np.arange(len(ids)) + 1).astype(np.int32), "place": at})

    bare = Dendrogram(sizes.select("run_key", (F.col("branch") - 1).alias("leaf"), F.col("branch").cast("bigint").alias("id")), top, tree.levels, tree.method)
    placed = in_order(bare).mapInArrow(place, "run_key bigint, branch int, place bigint")
    shown = Dendrogram(placed.select("run_key", (F.col("branch") - 1).alias("leaf"), F.col("branch").cast("bigint").alias("id"), "place"), top, tree.levels, tree.method)
    return segments(shown), sizes.join(placed, ["run_key", "branch"]).select("run_key", "branch", (F.col("place") + 1).alias("x"), "size")


def rollup(labels: DataFrame, facts: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures of facts (run_key, id, ...) at each cut: one row for each (run_key, k, cl)."""
    return labels.join(facts, ["run_key", "id"]).groupBy("run_key", "k", "cl").agg(*[m.alias(n) for n, m in measures.items()])
