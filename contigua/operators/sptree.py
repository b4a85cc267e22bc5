"""Spanning-tree priors of partitions, from tables of edges and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.functions.special import lgamma
from contigua.operators.dendrogram import arrays_of, in_order
from contigua.operators.fit import each_run
from contigua.operators.graph import quotient, renewed
from contigua.operators.trees import log_trees
from contigua.plans.shared import Kept
from contigua.types import Dendrogram


def log_spanning_trees(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ln_trees): ln of the number of spanning trees of each graph. nodes (keys, id), edges (keys, src, dst[, w])."""
    weighted = "w" in edges.columns
    schema = ", ".join(f"{k} {dict(nodes.dtypes)[k]}" for k in keys)

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({**{k: [] for k in keys}, "ln_trees": []})
        ids = np.unique(n["id"].to_numpy())
        at = np.searchsorted(ids, e[["src", "dst"]].to_numpy()).tolist() if len(e) else []
        value = log_trees(len(ids), at, e["w"].tolist() if weighted and len(e) else None)
        return pd.DataFrame({**{k: [n[k].iloc[0]] for k in keys}, "ln_trees": [value]})

    cols = [*keys, "src", "dst", *(["w"] if weighted else [])]
    return nodes.select(*keys, "id").groupBy(*keys).cogroup(renewed(edges, *cols).groupBy(*keys)).applyInPandas(run, f"{schema}, ln_trees double")


def partition_prior(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_key, intra, inter): ln spanning trees within the clusters of a partition (run_key, id, cl), and of the graph between them."""
    inside, between = quotient(edges, labels)
    intra = log_spanning_trees(labels.select("run_key", "cl", "id"), inside, ["run_key", "cl"]).groupBy("run_key").agg(F.sum("ln_trees").alias("intra"))
    clusters = labels.select("run_key", F.col("cl").cast("bigint").alias("id")).distinct()
    links = between.select("run_key", F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("dst"), F.col("w").cast("double").alias("w"))
    return intra.join(log_spanning_trees(clusters, links, ["run_key"]).withColumnRenamed("ln_trees", "inter"), "run_key")


def cut_cost(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_key, cost): ln spanning trees of a graph less those within its clusters, less ln of the number of edges between them."""
    inside, between = quotient(edges, labels)
    whole = log_spanning_trees(labels.select("run_key", "id"), edges, ["run_key"])
    parts = log_spanning_trees(labels.select("run_key", "cl", "id"), inside, ["run_key", "cl"]).groupBy("run_key").agg(F.sum("ln_trees").alias("parts"))
    cut = between.groupBy("run_key").agg(F.sum("w").alias("cut"))
    return whole.join(parts, "run_key").join(cut, "run_key").select("run_key", (F.col("ln_trees") - F.col("parts") - F.log("cut")).alias("cost"))


def _tops(tree: Dendrogram, most: int) -> DataFrame:
    """The nodes of the top of each tree: (run_key, id, node, own, null, null) for each row the nodes that hold it, own marking the lowest; and (run_key, null, node, null, first, last): the cuts that a node is in.

    Cuts are those into 1 to `most` clusters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_run(batches):
            ids, pairs, _ = arrays_of(t)
            n = len(ids)
            low = n - min(most, n)
            up = np.full(2 * n - 1, -1)
            up[pairs.ravel()] = np.repeat(n + np.arange(n - 1), 2)
            top = np.arange(2 * n - 1)
            for m in range(low):
                top[pairs[m]] = n + m
            for i in range(2 * n - 2, -1, -1):
                top[i] = i if top[i] == i else top[top[i]]
            at, own, held = top[:n], True, np.arange(n)
            nodes = [np.unique(at)]
            while len(held):
                yield pa.record_batch([np.full(len(held), key), ids[held], at, np.full(len(held), own), pa.nulls(len(held), pa.int32()), pa.nulls(len(held), pa.int32())], schema=TOPS)
                at, own = up[at], False
                held, at = held[at >= 0], at[at >= 0]
                nodes.append(np.unique(at))
            node = np.unique(np.concatenate(nodes))
            # node n + m - 1 is there from the cut into n - m clusters; its parent's merge ends it
            last = np.where(node < n, n, 2 * n - 1 - node)
            first = np.where(up[node] >= 0, 2 * n - up[node], 1)
            yield pa.record_batch([np.full(len(node), key), pa.nulls(len(node), pa.int64()), node, pa.nulls(len(node), pa.bool_()), first.astype(np.int32), np.minimum(last, min(most, n)).astype(np.int32)], schema=TOPS)

    return in_order(tree).mapInArrow(run, "run_key bigint, id bigint, node bigint, own boolean, first int, last int")


TOPS = pa.schema([("run_key", pa.int64()), ("id", pa.int64()), ("node", pa.int64()), ("own", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])


def tree_prior(tree: Dendrogram, edges: DataFrame, most: int) -> DataFrame:
    """(run_key, k, inter, intra, cnk, ptot, gain): the prior of each cut from 1 to `most` clusters, computed anew from the graph.

    cnk is ln C(n - 1, k - 1); ptot = inter + intra - intra at one cluster - cnk - ln k!. A cluster that is in several cuts is
    counted once: of an edge there is a copy for each cluster that holds it, not for each cut.
    """
    tops = Kept(_tops(tree, most), "tops").df
    held, spans = tops.where("id is not null"), tops.where("id is null").select("run_key", "node", "first", "last")
    end = lambda c: held.select("run_key", F.col("id").alias(c), "node")
    inside = edges.select("run_key", "src", "dst").join(end("src"), ["run_key", "src"]).join(end("dst"), ["run_key", "dst", "node"])
    counts = log_spanning_trees(held.select("run_key", "node", "id"), inside.select("run_key", "node", "src", "dst"), ["run_key", "node"])
    each = lambda df: df.withColumn("k", F.explode(F.sequence("first", "last")))
    intra = each(spans.join(counts, ["run_key", "node"])).groupBy("run_key", "k").agg(F.sum("ln_trees").alias("intra"))

    # between the clusters of a cut: from the counted edges between those of the finest one
    own = held.where("own").select("run_key", "id", F.col("node").alias("cl"))
    fine = Kept(quotient(edges, own)[1], "quotient").df
    above = each(held.join(own, ["run_key", "id"]).select("run_key", "cl", "node").distinct().join(spans, ["run_key", "node"])).select("run_key", "cl", "node", "k")
    side = lambda c: above.select("run_key", F.col("cl").alias(c), F.col("node").alias(f"{c}_node"), "k")
    links = fine.join(side("a"), ["run_key", "a"]).join(side("b"), ["run_key", "b", "k"]).where("a_node <> b_node").groupBy("run_key", "k", F.col("a_node").alias("src"), F.col("b_node").alias("dst")).agg(F.sum("w").cast("double").alias("w"))
    inter = log_spanning_trees(above.select("run_key", "k", F.col("node").alias("id")).distinct(), links, ["run_key", "k"]).withColumnRenamed("ln_trees", "inter")

    n = tree.leaves.groupBy("run_key").agg(F.count("*").alias("n"))
    prior = intra.join(inter, ["run_key", "k"])
    whole = intra.where("k = 1").select("run_key", F.col("intra").alias("whole"))
    rows = prior.join(n, "run_key").join(whole, "run_key").join(tree.levels.select("run_key", "k", (-F.col("level")).alias("gain")), ["run_key", "k"])

    def finish(batches):
        for pdf in batches:
            k, m = pdf["k"].to_numpy(float), pdf["n"].to_numpy(float)
            cnk = lgamma(m) - lgamma(k) - lgamma(m - k + 1)
            ptot = pdf["inter"] + pdf["intra"] - pdf["whole"] - cnk - lgamma(k + 1)
            yield pd.DataFrame({"run_key": pdf["run_key"], "k": pdf["k"], "inter": pdf["inter"], "intra": pdf["intra"], "cnk": cnk, "ptot": ptot, "gain": pdf["gain"]})

    return rows.select("run_key", "k", "inter", "intra", "n", "whole", "gain").mapInPandas(finish, "run_key bigint, k int, inter double, intra double, cnk double, ptot double, gain double")
