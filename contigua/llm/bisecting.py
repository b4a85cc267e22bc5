"""Similarity clusters by bisecting k-means over pre-aggregated cells, with exact tests of the leaves."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.plans.shared import Kept


#: Rounds of 2-means in a split, in one task as across the cluster.
ROUNDS = 4


@dataclass(frozen=True)
class Limits:
    """radius: no member of a leaf is farther from its centre; cell: side of the cells rows are counted in before clustering."""

    radius: float
    cell: float
    node_cells: int = 100_000
    block_rows: int = 5_000


def vectors(rows: DataFrame, key: str, features: list[str], *, above: float | None = None) -> DataFrame:
    """(id, x0, x1, ...): one row for each id whose features are all present, finite and, if given, above a bound.

    Of several rows of one id the least counts.
    """
    xs = [F.col(f"`{f}`").cast("double") for f in features]
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        if above is not None:
            ok = ok & (x > above)
    held = rows.where(F.col(f"`{key}`").isNotNull() & ok).groupBy(F.col(f"`{key}`").alias("id")).agg(F.min(F.struct(*[x.alias(f"x{i}") for i, x in enumerate(xs)])).alias("v"))
    return held.select("id", *[F.col(f"v.x{i}").alias(f"x{i}") for i in range(len(xs))])


def _cells(points: DataFrame, d: int, side: float) -> DataFrame:
    """Counts, sums and the tight box of the points of each cell."""
    sums = [f(F.col(f"x{i}")).alias(f"{n}{i}") for i in range(d) for f, n in ((F.sum, "s"), (F.min, "a"), (F.max, "b"))]
    return _in_cells(points, d, side).groupBy(*[f"c{i}" for i in range(d)]).agg(F.count("*").alias("n"), *sums)


def _in_cells(points: DataFrame, d: int, side: float) -> DataFrame:
    return points.withColumns({f"c{i}": F.floor(F.col(f"x{i}") / side).cast("bigint") for i in range(d)})


def _corner(lo: np.ndarray, hi: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distance from a centre to the farthest corner of each box."""
    return np.sqrt((np.maximum(np.abs(lo - centre), np.abs(hi - centre)) ** 2).sum(axis=1))


def _main_axis(scatter: np.ndarray) -> np.ndarray:
    """The direction of most dispersion, its largest part above 0."""
    axis = np.linalg.eigh(scatter)[1][:, -1]
    return axis if axis[np.argmax(np.abs(axis))] > 0 else -axis


def bisect(weight: np.ndarray, mean: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: float, rounds: int = ROUNDS) -> np.ndarray:
    """Leaf numbers of weighted cells: the node with the largest dispersion is split by 2-means until all leaves are compact.

    A split starts from both sides of the mean along the main axis; ties stay on the lower side. A node of one cell is a leaf.
    """
    leaf = np.zeros(len(weight), int)
    done, heap, made = 0, [], 0

    def node(members: np.ndarray) -> None:
        nonlocal done, made
        w, x = weight[members], mean[members]
        centre = (w[:, None] * x).sum(axis=0) / w.sum()
        if len(members) == 1 or _corner(lo[members], hi[members], centre).max() <= radius:
            leaf[members] = done
            done += 1
        else:
            made += 1
            heapq.heappush(heap, (-float((w[:, None] * (x - centre) ** 2).sum()), made, members))

    if len(weight):
        node(np.arange(len(weight)))
    while heap:
        members = heapq.heappop(heap)[2]
        w, x = weight[members], mean[members]
        centre = (w[:, None] * x).sum(axis=0) / w.sum()
        along = (x - centre) @ _main_axis(((x - centre) * w[:, None]).T @ (x - centre))
        right = along > 0
        if not right.any() or right.all():
            right = along > np.median(along)
        if not right.any():
            right = np.arange(len(members)) >= len(members) // 2
        for _ in range(rounds):
            one = np.average(x[~right], axis=0, weights=w[~right])
            two = np.average(x[right], axis=0, weights=w[right])
            now = ((x - two) ** 2).sum(axis=1) < ((x - one) ** 2).sum(axis=1)
            if (now == right).all() or not now.any() or now.all():
                break
            right = now
        node(members[~right])
        node(members[right])
    return leaf


def _split_large(cells: DataFrame, d: int, most: int) -> Kept:
    """Cells with a node each, nodes of more than `most` cells split by 2-means across the cluster, by the rule of `bisect`.

    All nodes that are too large are split at once. A pass sums up both sides of each, and the sides' means, a row for each
    such node (fewer than cells / most), go back as a small table. Rows that stay and rows that move are told by comparing
    a projection with a bound: the main axis first, then the axis between the two means.
    """
    now = Kept(cells.withColumn("node", F.lit("r")), "cells")
    x = [F.col(f"s{i}") / F.col("n") for i in range(d)]
    w = F.sum("n")

    def planes(rows: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
        """(node, axis, bound): a cell is on the right side where its projection exceeds the bound."""
        return F.broadcast(now.df.sparkSession.createDataFrame([(k, [float(v) for v in axis], float(bound)) for k, (axis, bound) in rows.items()], "node string, axis array<double>, bound double"))

    def sided(rows: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
        along = sum((F.col("axis")[i] * x[i] for i in range(d)), F.lit(0.0))
        return now.df.join(planes(rows), "node", "left").withColumn("right", F.when(F.col("axis").isNotNull(), along > F.col("bound"))).drop("axis", "bound")

    while True:
        second = [F.sum(x[i] * x[j] * F.col("n")).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
        stats = now.df.groupBy("node").agg(F.count("*").alias("cells"), w.alias("w"), *[(F.sum(f"s{i}") / w).alias(f"m{i}") for i in range(d)], *second).where(F.col("cells") > most).collect()
        if not stats:
            return now
        split = {}
        for r in stats:
            m = np.array([r[f"m{i}"] for i in range(d)])
            q = np.array([[r[f"q{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
            axis = _main_axis(q - r["w"] * np.outer(m, m))
            split[r["node"]] = (axis, float(axis @ m))
        for _ in range(ROUNDS):
            means = sided(split).where("right is not null").groupBy("node", "right").agg(*[(F.sum(f"s{i}") / w).alias(f"m{i}") for i in range(d)]).collect()
            ends = {(r["node"], r["right"]): np.array([r[f"m{i}"] for i in range(d)]) for r in means}
            after = dict(split)
            for k in split:
                if (k, True) in ends and (k, False) in ends:
                    one, two = ends[k, False], ends[k, True]
                    after[k] = (two - one, float((two @ two - one @ one) / 2))
            if all(np.array_equal(after[k][0], split[k][0]) and after[k][1] == split[k][1] for k in split):
                break
            split = after
        parted = sided(split).withColumn("node", F.when(F.col("right").isNull(), F.col("node")).otherwise(F.concat("node", F.when(F.col("right"), "1").otherwise("0")))).drop("right")
        after_split = Kept(parted, "cells")
        now.drop()
        now = after_split


def leaves_of(points: DataFrame, d: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(points with their leaf, cells with their leaf): the compact leaves of a bisecting k-means tree.

    Points are first counted in cells, so that what is clustered is bounded by the space they fill, not by their number.
    While a node has over `node_cells` cells it is split across the cluster; smaller ones are finished in one task each.
    """
    cells = _cells(points, d, limits.cell)
    noded = _split_large(cells, d, limits.node_cells)
    keys = [f"c{i}" for i in range(d)]
    boxes = [f"{e}{i}" for e in "ab" for i in range(d)]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["n"].to_numpy(float)
        mean = np.stack([pdf[f"s{i}"].to_numpy() / w for i in range(d)], axis=1)
        lo, hi = (np.stack([pdf[f"{e}{i}"].to_numpy() for i in range(d)], axis=1) for e in "ab")
        out = pdf[keys + boxes].copy()
        out["leaf"] = [f"{pdf['node'].iloc[0]}-{k}" for k in bisect(w, mean, lo, hi, limits.radius)]
        return out

    schema = ", ".join([*[f"{k} long" for k in keys], *[f"{b} double" for b in boxes], "leaf string"])
    order = noded.df.groupBy("node").applyInPandas(lambda pdf: finish(pdf.sort_values(keys, ignore_index=True)), schema)
    done = Kept(order, "leaves")
    noded.drop()
    # the cells number far fewer than the points; Spark broadcasts them only while they are small, and else splits hot cells
    placed = _in_cells(points, d, limits.cell).join(done.df.select(*keys, "leaf"), keys).drop(*keys)
    return placed, done.df


def typical_members(rows: DataFrame, key: str, features: list[str], limits: Limits, *, above: float | None = None, members: int = 3) -> DataFrame:
    """(leaf, size, centre, radius, rank, id, distance): each leaf with its `members` links nearest to its centre.

    Defined cases: ids with a missing, infinite or too low feature are in no leaf; repeated rows count once; ties in
    distance are ordered by id; an empty table gives no leaves; other columns are not read.
    """
    d = len(features)
    placed, _ = leaves_of(vectors(rows, key, features, above=above), d, limits)
    placed = Kept(placed, "placed").df
    centres = placed.groupBy("leaf").agg(F.count("*").alias("size"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)])
    apart = F.sqrt(sum((F.pow(F.col(f"x{i}") - F.col(f"m{i}"), 2) for i in range(d)), F.lit(0.0)))
    near = placed.join(centres, "leaf").withColumn("distance", apart)
    radius = near.groupBy("leaf").agg(F.max("distance").alias("radius"))
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy("distance", "id"))).where(F.col("rank") <= members)
    return top.join(radius, "leaf").select("leaf", "size", F.array(*[f"m{i}" for i in range(d)]).alias("centre"), "radius", "rank", "id", "distance")


def _gap2(a: np.ndarray, b: np.ndarray, c: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between points of the boxes (a, b) and (c, e), as a matrix."""
    low = np.maximum(np.maximum(a[:, None] - e[None], c[None] - b[:, None]), 0)
    high = np.maximum(np.abs(b[:, None] - c[None]), np.abs(e[None] - a[:, None]))
    return (low**2).sum(axis=2), (high**2).sum(axis=2)


def alike_groups(rows: DataFrame, key: str, features: list[str], distance: float, *, above: float | None = None, least: int = 3, limits: Limits | None = None) -> DataFrame:
    """(id, cluster_id): groups of at least `least` ids of which any two are alike and none is alike to an id outside.

    Two ids are alike if the Euclidean distance of their features is at most `distance`; cluster_id is a group's least id.

    The leaves of bisecting k-means with radius distance / 2 are cliques of alike ids. Leaves whose boxes come within
    `distance` are compared: by their cells' boxes, and where those leave it open by their points, in blocks of bounded
    size. A group is then a set of leaves that all touch each other and no other leaf, with all points of them alike.

    Defined cases: as in typical_members; ids of equal features are alike; a group cut by a split is put together again.
    """
    d = len(features)
    limits = limits or Limits(radius=distance / 2, cell=distance / 20)
    far2 = distance * distance
    placed, cells = leaves_of(vectors(rows, key, features, above=above), d, limits)
    points = Kept(placed, "placed").df
    lo, hi = [f"a{i}" for i in range(d)], [f"b{i}" for i in range(d)]
    leaf = Kept(cells.groupBy("leaf").agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi]), "boxes").df

    # leaves whose boxes come within the distance: met in coarse cells that their widened boxes cover
    wide = 2 * distance
    span = leaf
    for i in range(d):
        span = span.withColumn(f"g{i}", F.explode(F.sequence(F.floor((F.col(f"a{i}") - distance / 2) / wide), F.floor((F.col(f"b{i}") + distance / 2) / wide))))
    other = span.select(*[F.col(f"g{i}") for i in range(d)], F.col("leaf").alias("leaf2"), *[F.col(c).alias(f"{c}_2") for c in lo + hi])
    gap = sum((F.pow(F.greatest(F.col(f"a{i}") - F.col(f"b{i}_2"), F.col(f"a{i}_2") - F.col(f"b{i}"), F.lit(0.0)), 2) for i in range(d)), F.lit(0.0))
    near = span.join(other, [f"g{i}" for i in range(d)]).where((F.col("leaf") < F.col("leaf2")) & (gap <= far2 * (1 + 1e-12))).select("leaf", "leaf2").distinct()

    boxes = cells.select("leaf", *lo, *hi)
    both = near.join(boxes, "leaf").select("leaf", "leaf2", F.lit(0).alias("of"), *lo, *hi).unionByName(near.join(boxes.withColumnRenamed("leaf", "leaf2"), "leaf2").select("leaf", "leaf2", F.lit(1).alias("of"), *lo, *hi))

    def by_boxes(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["of"] == 0], pdf[pdf["of"] == 1]
        a, b, c, e = one[lo].to_numpy(), one[hi].to_numpy(), two[lo].to_numpy(), two[hi].to_numpy()
        sure_near = maybe_near = sure_far = maybe_far = False
        for at in range(0, len(a), step := max(1, 2_000_000 // max(1, len(c)))):
            low, high = _gap2(a[at : at + step], b[at : at + step], c, e)
            sure_near, maybe_near = sure_near or bool((high <= far2).any()), maybe_near or bool((low <= far2).any())
            sure_far, maybe_far = sure_far or bool((low > far2).any()), maybe_far or bool((high > far2).any())
        touch = True if sure_near else (None if maybe_near else False)
        alike = False if sure_far else (None if maybe_far else True)
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "leaf2": [pdf["leaf2"].iloc[0]], "touch": pd.array([touch], "boolean"), "alike": pd.array([alike], "boolean")})

    seen = Kept(both.groupBy("leaf", "leaf2").applyInPandas(by_boxes, "leaf string, leaf2 string, touch boolean, alike boolean"), "pairs").df
    open_pairs = seen.where("touch is null or (touch and alike is null)")

    # what boxes leave open: first whether a ball of half the distance about the common box's centre holds both leaves
    xs = [f"x{i}" for i in range(d)]
    sides = {f"{c}_2": F.col(c) for c in lo + hi}
    leaf2 = leaf.select(F.col("leaf").alias("leaf2"), *[v.alias(k) for k, v in sides.items()])
    middle = [((F.least(f"a{i}", f"a{i}_2") + F.greatest(f"b{i}", f"b{i}_2")) / 2).alias(f"m{i}") for i in range(d)]
    open_pairs = seen.where("touch is null or (touch and alike is null)").join(leaf, "leaf").join(leaf2, "leaf2").select("*", *middle)
    from_middle = F.sqrt(sum((F.pow(F.col(f"x{i}") - F.col(f"m{i}"), 2) for i in range(d)), F.lit(0.0)))
    ends = [open_pairs.withColumn("own", F.col(c)).drop(*xs) for c in ("leaf", "leaf2")]
    owned = points.select(F.col("leaf").alias("own"), "id", *xs)
    reach = ends[0].unionByName(ends[1]).join(owned, "own").groupBy("leaf", "leaf2").agg(F.max(from_middle).alias("reach"))
    balls = Kept(open_pairs.join(reach, ["leaf", "leaf2"]).withColumn("alike", F.when(F.col("reach") <= distance / 2, F.lit(True)).otherwise(F.col("alike"))), "balls").df

    # then by the points themselves, block against block; a point in a far pair is farther from the centre than distance - reach
    blocks = points.groupBy("leaf").agg(F.ceil(F.count("*") / limits.block_rows).cast("int").alias("blocks"))
    pairs = balls.where("touch is null or alike is null").join(blocks.withColumnRenamed("blocks", "k1"), "leaf").join(blocks.select(F.col("leaf").alias("leaf2"), F.col("blocks").alias("k2")), "leaf2")

    def matters(other: str) -> Column:
        to_box = sum((F.pow(F.greatest(F.col(f"a{i}{other}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"b{i}{other}"), F.lit(0.0)), 2) for i in range(d)), F.lit(0.0))
        return (F.col("touch").isNull() & (to_box <= far2 * (1 + 1e-9))) | (F.col("alike").isNull() & (from_middle > distance - F.col("reach") - 1e-9))

    first = pairs.join(points, "leaf").where(matters("_2")).withColumn("i", F.pmod(F.xxhash64("id"), "k1").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k2") - 1))).select("leaf", "leaf2", "i", "j", F.lit(0).alias("of"), *xs)
    second = pairs.join(points.withColumnRenamed("leaf", "leaf2"), "leaf2").where(matters("")).withColumn("j", F.pmod(F.xxhash64("id"), "k2").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k1") - 1))).select("leaf", "leaf2", "i", "j", F.lit(1).alias("of"), *xs)

    def by_points(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["of"] == 0][xs].to_numpy(), pdf[pdf["of"] == 1][xs].to_numpy()
        least, most = np.inf, -np.inf
        for at in range(0, len(one) if len(two) else 0, 200):
            gaps = ((one[at : at + 200, None] - two[None]) ** 2).sum(axis=2)
            least, most = min(least, gaps.min()), max(most, gaps.max())
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "leaf2": [pdf["leaf2"].iloc[0]], "least": [least], "most": [most]})

    exact = first.unionByName(second).groupBy("leaf", "leaf2", "i", "j").applyInPandas(by_points, "leaf string, leaf2 string, least double, most double").groupBy("leaf", "leaf2").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    known = seen.select("leaf", "leaf2", "touch", "alike").join(balls.select("leaf", "leaf2", F.col("alike").alias("in_ball")), ["leaf", "leaf2"], "left")
    # pairs without points that matter have none near, or none far
    settled = known.join(exact, ["leaf", "leaf2"], "left").select("leaf", "leaf2", F.coalesce("touch", F.col("least") <= far2, F.lit(False)).alias("touch"), F.coalesce("alike", "in_ball", F.col("most") <= far2, F.lit(True)).alias("alike"))
    settled = Kept(settled.where("touch"), "settled").df

    # a leaf's closed neighbourhood; in a group all leaves have the same one, and it is all of the group
    ways = settled.unionByName(settled.select(F.col("leaf2").alias("leaf"), F.col("leaf").alias("leaf2"), "touch", "alike"))
    hood = (
        leaf.select("leaf", F.col("leaf").alias("leaf2"), F.lit(True).alias("alike"))
        .unionByName(ways.select("leaf", "leaf2", "alike"))
        .groupBy("leaf")
        .agg(F.count("*").alias("width"), F.min("leaf2").alias("head"), F.sum(F.xxhash64("leaf2").cast("decimal(20,0)")).alias("mark"), F.bool_and("alike").alias("alike"))
    )
    whole = hood.groupBy("head", "mark", "width").agg(F.count("*").alias("have"), F.bool_and("alike").alias("alike")).where("have = width and alike")
    members = points.join(hood.join(whole.select("head", "mark", "width"), ["head", "mark", "width"], "left_semi").select("leaf", "head"), "leaf").select("head", "id")
    named = members.groupBy("head").agg(F.count("*").alias("n"), F.min("id").alias("cluster_id")).where(F.col("n") >= least)
    return members.join(named, "head").select("id", "cluster_id")
