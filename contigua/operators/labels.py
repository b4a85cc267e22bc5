"""Components of graphs across the cluster, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from contigua.plans.shared import Kept


def least_labels(nodes: DataFrame, edges: DataFrame) -> Kept:
    """(run_key, id, label): the least id that edges (run_key, src, dst), in both directions, connect each node to.

    In each round a node takes the least label of its closed neighbourhood, and then the label of the node which that label
    names, so that labels travel twice as far as in the round before. Rounds end when none falls any more; each is written.
    """
    now = Kept(nodes.select("run_key", "id", F.col("id").alias("label")), "labels")
    while True:
        near = edges.join(now.df.withColumnRenamed("id", "dst"), ["run_key", "dst"]).groupBy("run_key", F.col("src").alias("id")).agg(F.min("label").alias("near"))
        told = now.df.join(near, ["run_key", "id"], "left").select("run_key", "id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        told = Kept(told, "labels")
        ahead = told.df.select("run_key", F.col("id").alias("label"), F.col("label").alias("far"))
        moved = Observation()
        after = told.df.join(ahead, ["run_key", "label"]).select("run_key", "id", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("fell"))
        after = Kept(after.observe(moved, F.count_if("fell").alias("n")).drop("fell"), "labels")
        now.drop()
        told.drop()
        now = after
        if not moved.get["n"]:
            return now
