"""Contiguity graphs as edge tables (run_key, src, dst), src < dst, distinct, without loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.operators.delaunay import triangulation_edges
from contigua.operators.labels import least_labels
from contigua.plans.shared import Kept


def renewed(df: DataFrame, *cols: str) -> DataFrame:
    """Columns under identities of their own, so that tables made from one another can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in cols])


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges in either direction, repeated or with loops, as a contiguity graph."""
    return edges.where("src <> dst").select("run_key", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("run_key", F.col("dst").alias("src"), F.col("src").alias("dst")))


def chain(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each row adjacent to the next of its run. rows (run_key, id, ...)."""
    w = Window.partitionBy("run_key").orderBy(*order)
    return canonical_edges(rows.select("run_key", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null"))


def within_distance(points: DataFrame, eps: float) -> DataFrame:
    """Points (run_key, id, x, y) at most eps apart: met in cells of side eps, of which each point goes to itself and half the neighbours."""
    p = points.select("run_key", "id", "x", "y").where("not isnan(x) and not isnan(y)").withColumns({"cx": F.floor(F.col("x") / eps), "cy": F.floor(F.col("y") / eps)})
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    sent = p.withColumn("o", F.explode(half)).select("run_key", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"))
    met = p.join(sent, ["run_key", "cx", "cy"]).where((~F.col("own") | (F.col("id") < F.col("id2"))) & (F.col("id") != F.col("id2")))
    near = met.where(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= eps * eps)
    return near.select("run_key", F.least("id", "id2").alias("src"), F.greatest("id", "id2").alias("dst")).distinct()


def nearest(points: DataFrame, k: int = 3) -> DataFrame:
    """Each point (run_key, id, x, y) with its k - 1 nearest others (k counts the point itself), made symmetric. Ties go to the lower id.

    Cells are halved again and again; a point looks for neighbours in cells twice as wide as the smallest of its own that
    holds k points. The 3 x 3 of them around it hold its nearest for certain, and few more: dense places have small cells,
    empty ones large cells. Of points at one place only the k lowest ids can be anybody's nearest.

    Missing or infinite coordinates raise an error. A run with fewer than k points links all of them.
    """
    want = k - 1
    none = points.select("run_key", F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    if want < 1:
        return none
    p = points.select("run_key", "id", F.col("x").cast("double"), F.col("y").cast("double")).dropDuplicates(["run_key", "id"])
    fine = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))  # false for NaN, which is greater than any number
    stats = p.groupBy("run_key").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    stats = stats.agg(F.max("n").alias("n"), F.sum("bad").alias("bad"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("width")).first()
    if not stats["n"]:
        return none
    if stats["bad"]:
        raise ValueError("Some regions have missing values and missing values are not allowed.")
    top = min(30, int(np.ceil(np.log2(max(2.0, stats["n"] ** 0.5)))) + 8)
    unit = max(stats["width"], 1e-300) / 2**top
    at = lambda c: F.least(F.floor((F.col(c) - stats[f"{c}0"]) / unit), F.lit(2**top - 1)).cast("bigint")
    p = Kept(p.withColumns({"ix": at("x"), "iy": at("y")}), "points").df

    keys = ["run_key", "level", "cx", "cy"]
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    cell = lambda c: F.expr(f"shiftright(i{c}, level)").alias(f"c{c}")
    counts = p.groupBy("run_key", "ix", "iy").agg(F.count("*").alias("n"))
    full = counts.select("run_key", "ix", "iy", "n", levels).groupBy("run_key", "level", cell("x"), cell("y")).agg(F.sum("n").alias("n")).where(F.col("n") >= k).select(*keys)
    own = counts.select("run_key", "ix", "iy", levels).withColumns({"cx": cell("x"), "cy": cell("y")}).join(full, keys, "left_semi").groupBy("run_key", "ix", "iy").agg(F.min("level").alias("level"))
    seek = p.join(own, ["run_key", "ix", "iy"], "left").withColumn("level", F.coalesce("level", F.lit(top)) + 1)
    seek = Kept(seek.select("run_key", F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), "level", cell("x"), cell("y")), "seek").df
    used = [r["level"] for r in seek.select("level").distinct().collect()]  # at most 31

    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("o")
    asked = seek.select("run_key", "src", "sx", "sy", "level", "cx", "cy", around).withColumns({"cx": F.col("cx") + F.col("o.dx"), "cy": F.col("cy") + F.col("o.dy")}).drop("o")
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("run_key", "x", "y").orderBy("id"))).where(F.col("r") <= k)
    held = first.select("run_key", "id", "x", "y", "ix", "iy", F.explode(F.array(*[F.lit(v) for v in used])).alias("level")).withColumns({"cx": cell("x"), "cy": cell("y")})
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    met = asked.join(held, keys).where("src <> id").select("run_key", "src", F.col("id").alias("dst"), d2.alias("d2"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("run_key", "src").orderBy("d2", "dst"))).where(F.col("r") <= want)
    return canonical_edges(best.select("run_key", "src", "dst"))


def delaunay(points: DataFrame) -> DataFrame:
    """Edges of the Delaunay triangulation of each run's points (run_key, id, x, y); a run is triangulated in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        e = triangulation_edges(pdf[["x", "y"]].to_numpy(float))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"run_key": pdf["run_key"].iloc[0], "src": ids[e[:, 0]] if len(e) else [], "dst": ids[e[:, 1]] if len(e) else []})

    return canonical_edges(points.select("run_key", "id", "x", "y").groupBy("run_key").applyInPandas(run, "run_key bigint, src bigint, dst bigint"))


def space_time(edges: DataFrame, times: DataFrame, stride: int) -> DataFrame:
    """The product of a graph (run_key, src, dst) and time slices (run_key, id, t): neighbours in each slice, and each cell with itself a slice later.

    Node (id, t) is numbered id * stride + t; t must be from 0 to stride - 1.
    """
    node = lambda i, t: F.col(i) * stride + F.col(t)
    here = times.select("run_key", "id", "t").distinct()
    a = here.withColumnsRenamed({"id": "src", "t": "ta"})
    b = here.withColumnsRenamed({"id": "dst", "t": "tb"})
    space = edges.join(a, ["run_key", "src"]).join(b, ["run_key", "dst"]).where("ta = tb").select("run_key", node("src", "ta").alias("src"), node("dst", "tb").alias("dst"))
    after = F.lead("t").over(Window.partitionBy("run_key", "id").orderBy("t"))
    time = here.withColumn("next", after).where("next = t + 1").select("run_key", node("id", "t").alias("src"), node("id", "next").alias("dst"))
    return canonical_edges(space.unionByName(time))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("run_key", F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(run_key, i, j, w): the adjacency matrix."""
    return both_ways(edges).select("run_key", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("w"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(run_key, i, j, w): degrees on the diagonal less the adjacency matrix."""
    a = adjacency(edges)
    return a.groupBy("run_key", "i").agg(F.sum("w").alias("w")).select("run_key", "i", F.col("i").alias("j"), "w").unionByName(a.withColumn("w", -F.col("w")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_key, id, component): the least id of each node's component, found across the cluster. Edges with an end that is no node don't count."""
    ids = nodes.select("run_key", "id").distinct()
    e = canonical_edges(renewed(edges, "run_key", "src", "dst"))
    for end in ("src", "dst"):
        e = e.join(ids.withColumnRenamed("id", end), ["run_key", end], "left_semi")
    e = Kept(both_ways(e.select("run_key", "src", "dst")), "edges")
    found = least_labels(ids, e.df)
    e.drop()
    return found.df.withColumnRenamed("label", "component")


def require_connected(nodes: DataFrame, edges: DataFrame) -> None:
    c = components(nodes, edges)
    if c.groupBy("run_key").agg(F.count_distinct("component").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("The graph is not connected, several components found.")


def quotient(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a partition (run_key, id, cl) makes of a graph: (edges inside clusters with cl, weighted edges (run_key, a, b, w) between them)."""
    lab = lambda end: labels.select("run_key", F.col("id").alias(end), F.col("cl").alias(f"cl_{end}"))
    named = edges.join(lab("src"), ["run_key", "src"]).join(lab("dst"), ["run_key", "dst"])
    inside = named.where("cl_src = cl_dst").select("run_key", F.col("cl_src").alias("cl"), "src", "dst")
    cut: Column = F.col("cl_src") != F.col("cl_dst")
    between = named.where(cut).groupBy("run_key", F.least("cl_src", "cl_dst").alias("a"), F.greatest("cl_src", "cl_dst").alias("b")).agg(F.count("*").alias("w"))
    return inside, between
