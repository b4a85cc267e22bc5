"""Contiguity of polygons and lines, and unions of clusters' geometries.

POINT is STRUCT<x, y>, LINE an ARRAY of points, POLYGON an ARRAY of rings (the first the outline, the others holes), and a
MULTI geometry one more ARRAY.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contigua.operators.graph import canonical_edges


def geometry_kind(df: DataFrame, col: str = "geometry") -> str:
    """`point`, `line` (or several points), `polygon` (or several lines) or `multipolygon`, known from the schema."""
    kind, depth = df.schema[col].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if not (isinstance(kind, T.StructType) and {"x", "y"} <= set(kind.fieldNames()) and depth <= 3):
        raise ValueError("The dataset must be an object with a geometry of points, lines or polygons.")
    return ("point", "line", "polygon", "multipolygon")[depth]


def require_kind(df: DataFrame, *kinds: str, col: str = "geometry") -> None:
    if geometry_kind(df, col) not in kinds:
        raise ValueError(f"The dataset must contain only {' or '.join(kinds)} geometries.")


def _cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def polygon_segments(polygons: DataFrame) -> DataFrame:
    """(run_key, id, ax, ay, bx, by): boundary segments, each with the polygon's inside on its left."""
    rings = polygons.select("run_key", "id", F.posexplode("geometry").alias("ring", "p")).where(F.size("p") > 2)
    nxt = F.concat(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, 1))
    pairs = rings.select("run_key", "id", "ring", F.filter(F.arrays_zip(F.col("p").alias("a"), nxt.alias("b")), lambda s: (s["a"]["x"] != s["b"]["x"]) | (s["a"]["y"] != s["b"]["y"])).alias("s"))
    area = F.aggregate("s", F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    turn = (area > 0) != (F.col("ring") == 0)
    each = pairs.withColumn("turn", turn).select("run_key", "id", "turn", F.explode("s").alias("s"))
    pick = lambda e, o, c: F.when(F.col("turn"), F.col(f"s.{o}.{c}")).otherwise(F.col(f"s.{e}.{c}"))
    return each.select("run_key", "id", pick("a", "b", "x").alias("ax"), pick("a", "b", "y").alias("ay"), pick("b", "a", "x").alias("bx"), pick("b", "a", "y").alias("by"))


def _met(segments: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Pairs of segments of different ids whose boxes meet, found in the cells that they run through; cells are about as wide as the mean segment.

    A long segment has a cell for each width that it is long, not for each of its box. extra: further columns of the second
    segment, under other names.
    """
    side = segments.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0
    slack = side * 1e-6  # points that touch within rounding share a cell
    floor = lambda v: F.floor(v / side)
    x0, x1, y0, y1 = (f(f"a{c}", f"b{c}") for c in "xy" for f in (F.least, F.greatest))
    spread = segments.withColumn("gx", F.explode(F.sequence(floor(x0 - slack), floor(x1 + slack))))
    # the part of the segment within the column
    dx = F.col("bx") - F.col("ax")
    at = lambda x: F.when(dx == 0, F.col("ay")).otherwise(F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / dx)
    left, right = F.greatest(x0, F.col("gx") * side - slack), F.least(x1, (F.col("gx") + 1) * side + slack)
    flat = F.abs(dx) <= slack
    low = F.when(flat, y0).otherwise(F.greatest(y0, F.least(at(left), at(right))))
    high = F.when(flat, y1).otherwise(F.least(y1, F.greatest(at(left), at(right))))
    spread = spread.withColumn("gy", F.explode(F.sequence(floor(F.least(low, high) - slack), floor(F.greatest(low, high) + slack))))
    other = spread.select("run_key", "gx", "gy", F.col("id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in ("ax", "ay", "bx", "by")], *[F.col(c).alias(n) for c, n in (extra or {}).items()])
    boxes = F.lit(True)
    for c in "xy":
        boxes = boxes & (F.least(f"a{c}", f"b{c}") <= F.greatest(f"a{c}2", f"b{c}2")) & (F.least(f"a{c}2", f"b{c}2") <= F.greatest(f"a{c}", f"b{c}"))
    return spread.join(other, ["run_key", "gx", "gy"]).where((F.col("id") < F.col("id2")) & boxes)


def _relations(pairs: DataFrame, eps: float, touching: bool = True) -> DataFrame:
    """For two segments: `overlap`, 1 if they share a piece in opposite and -1 in the same direction; `cross`; `touch`."""
    ax, ay, bx, by, cx, cy, dx, dy = (F.col(c) for c in ("ax", "ay", "bx", "by", "ax2", "ay2", "bx2", "by2"))
    ux, uy = bx - ax, by - ay
    length = F.sqrt(ux * ux + uy * uy)
    c1, c2 = _cross(ax, ay, bx, by, cx, cy) / length, _cross(ax, ay, bx, by, dx, dy) / length
    length2 = F.sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy))
    d1, d2 = _cross(cx, cy, dx, dy, ax, ay) / length2, _cross(cx, cy, dx, dy, bx, by) / length2
    along = lambda x, y: ((x - ax) * ux + (y - ay) * uy) / length
    t1, t2 = along(cx, cy), along(dx, dy)
    shared = F.least(length, F.greatest(t1, t2)) - F.greatest(F.lit(0.0), F.least(t1, t2))
    line = (F.abs(c1) <= eps) & (F.abs(c2) <= eps)
    overlap = F.when(line & (shared > eps), F.when(t1 > t2, 1).otherwise(-1)).otherwise(0)
    cross = (~line) & (c1 * c2 < 0) & (d1 * d2 < 0) & (F.least(F.abs(c1), F.abs(c2), F.abs(d1), F.abs(d2)) > eps)
    pairs = pairs.withColumns({"overlap": overlap, "cross": cross})
    if not touching:
        return pairs
    on = lambda o, p, n: (F.abs(o) <= eps) & (p >= -eps) & (p <= n + eps)
    back = lambda x, y: ((x - cx) * (dx - cx) + (y - cy) * (dy - cy)) / length2
    touch = on(c1, t1, length) | on(c2, t2, length) | on(d1, back(ax, ay), length2) | on(d2, back(bx, by), length2)
    return pairs.withColumn("touch", touch)


def polygon_neighbours(polygons: DataFrame, adjacency: str = "rook", eps: float = 1e-9) -> DataFrame:
    """Contiguity of polygons (run_key, id, geometry): rook if they share a piece of boundary, queen if they share a point.

    Polygons whose insides meet are not contiguous: crossing boundaries, or a shared piece with both insides on one side. The
    boundaries needn't share their vertices. eps is the distance up to which points count as equal.
    """
    if adjacency not in ("rook", "queen"):
        raise ValueError("adjacency must be rook or queen")
    seen = _relations(_met(polygon_segments(polygons)), eps)
    by = seen.groupBy("run_key", F.col("id").alias("src"), F.col("id2").alias("dst")).agg(F.max("overlap").alias("shared"), F.min("overlap").alias("inside"), F.bool_or("cross").alias("cross"), F.bool_or("touch").alias("touch"))
    apart = by.where((F.col("inside") >= 0) & ~F.col("cross"))
    return canonical_edges(apart.where(F.col("shared") > 0 if adjacency == "rook" else F.col("touch") | (F.col("shared") > 0)).select("run_key", "src", "dst"))


def line_neighbours(lines: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Contiguity of lines (run_key, id, geometry): they share an end point and their insides don't meet. Closed lines have no ends."""
    p = F.col("geometry")
    first, last = p[0], F.element_at(p, -1)
    ends = lines.select("run_key", "id", F.explode(F.array_distinct(F.array(first, last))).alias("e"), ((first["x"] == last["x"]) & (first["y"] == last["y"])).alias("closed")).where("not closed").select("run_key", "id", F.col("e.x").alias("ex"), F.col("e.y").alias("ey"))
    pairs = ends.join(ends.withColumnRenamed("id", "id2"), ["run_key", "ex", "ey"]).where("id < id2").select("run_key", "id", "id2").distinct()
    steps = F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b"))
    seg = lines.where(F.size("geometry") > 1).select("run_key", "id", first["x"].alias("p0x"), first["y"].alias("p0y"), last["x"].alias("p1x"), last["y"].alias("p1y"), F.explode(steps).alias("s")).select("run_key", "id", "p0x", "p0y", "p1x", "p1y", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).where("ax <> bx or ay <> by")
    # only segments that come near each other, of lines that share an end
    met = _met(seg, {f"p{k}": f"q{k}" for k in ("0x", "0y", "1x", "1y")}).join(pairs, ["run_key", "id", "id2"])
    both = _relations(met, eps, touching=False)

    def is_end(x: str, y: str) -> Column:
        return reduce(lambda rest, k: rest | ((F.col(x) == F.col(f"{k}x")) & (F.col(y) == F.col(f"{k}y"))), ("p0", "p1", "q0", "q1"), F.lit(False))

    inner_vertex = F.lit(False)
    for x, y in (("ax", "ay"), ("bx", "by")):
        for x2, y2 in (("ax2", "ay2"), ("bx2", "by2")):
            inner_vertex = inner_vertex | ((F.col(x) == F.col(x2)) & (F.col(y) == F.col(y2)) & ~is_end(x, y))
    bad = both.groupBy("run_key", "id", "id2").agg(F.bool_or(F.col("cross") | (F.col("overlap") != 0) | inner_vertex).alias("bad")).where("bad")
    return canonical_edges(pairs.join(bad, ["run_key", "id", "id2"], "left_anti").select("run_key", F.col("id").alias("src"), F.col("id2").alias("dst")))


def dissolve_polygons(polygons: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_key, cl, n, geometry): union of each cluster's polygons as rings, of meshes that share their vertices.

    Segments that two members run in opposite directions lie inside and cancel by counting; what is left is chained to rings.
    Outlines run with the inside on the left, holes with it on the right.
    """
    named = polygon_segments(polygons).join(labels.select("run_key", "id", "cl"), ["run_key", "id"])
    flip = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    left = (
        named.select("run_key", "cl", pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"), F.when(flip, -1).otherwise(1).alias("way"))
        .groupBy("run_key", "cl", "ax", "ay", "bx", "by")
        .agg(F.sum("way").alias("way"))
        .where("way <> 0")
    )

    def rings(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple, list[tuple]] = {}
        for ax, ay, bx, by, way in pdf[["ax", "ay", "bx", "by", "way"]].sort_values(["ax", "ay", "bx", "by"]).itertuples(index=False):
            a, b = ((ax, ay), (bx, by)) if way > 0 else ((bx, by), (ax, ay))
            after.setdefault(a, []).append(b)
        out = []
        while after:
            start = at = min(after)
            ring = [at]
            while True:
                nxt = after[at].pop(0)
                if not after[at]:
                    del after[at]
                ring.append(nxt)
                at = nxt
                if at == start or at not in after:
                    break
            out.append([{"x": x, "y": y} for x, y in ring])
        return pd.DataFrame({"run_key": [pdf["run_key"].iloc[0]], "cl": [pdf["cl"].iloc[0]], "geometry": [out]})

    shape = left.groupBy("run_key", "cl").applyInPandas(rings, "run_key bigint, cl int, geometry array<array<struct<x: double, y: double>>>")
    counts = labels.groupBy("run_key", "cl").agg(F.count("*").alias("n"))
    return counts.join(shape, ["run_key", "cl"]).select("run_key", "cl", "n", "geometry")


def dissolve_parts(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_key, cl, n, geometry): points or lines of each cluster as one multi geometry, in order of id."""
    both = parts.select("run_key", "id", "geometry").join(labels.select("run_key", "id", "cl"), ["run_key", "id"])
    held = both.groupBy("run_key", "cl").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "geometry"))).alias("g"))
    return held.select("run_key", "cl", "n", F.transform("g", lambda v: v["geometry"]).alias("geometry"))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, above 0 if it runs counter-clockwise."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v) / 2
