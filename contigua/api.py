"""One call from a table to a dendrogram, for each way to say which rows are adjacent.

Each takes a table with an id, numeric features and, where needed, a geometry; checks and scales the features; builds the
contiguity graph and fits. run_key names a column that parts the table in independent runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.operators import flows as O
from contigua.operators import geometry as S
from contigua.operators import graph as G
from contigua.operators.fit import fit_chain, fit_flows, fit_graph
from contigua.operators.prep import feature_table
from contigua.types import Dendrogram


def _keyed(df: DataFrame, id_col: str, run_key: str | None) -> DataFrame:
    """(run_key, id, geometry)."""
    key = F.col(run_key) if run_key else F.lit(0)
    return df.select(key.cast("bigint").alias("run_key"), F.col(id_col).cast("bigint").alias("id"), "geometry")


def _points(df: DataFrame, id_col: str, run_key: str | None) -> DataFrame:
    S.require_kind(df, "point")
    return _keyed(df, id_col, run_key).select("run_key", "id", F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"))


def by_order(df: DataFrame, id_col: str, order: str, *, run_key: str | None = None, features: list[str] | None = None, method: object = "ward", scaling: str = "raw") -> Dendrogram:
    """Each row adjacent to the next in order."""
    return fit_chain(feature_table(df, id_col, run_key, order, features, scaling), method)


def by_graph(df: DataFrame, edges: DataFrame, id_col: str, *, run_key: str | None = None, features: list[str] | None = None, method: object = "ward", scaling: str = "raw") -> Dendrogram:
    """Rows adjacent as a table of edges (run_key, src, dst) says; without a run_key there it is one run."""
    e = edges if "run_key" in edges.columns else edges.withColumn("run_key", F.lit(0).cast("bigint"))
    return fit_graph(feature_table(df, id_col, run_key, None, features, scaling), G.canonical_edges(e), method)


def by_delaunay(df: DataFrame, id_col: str, *, run_key: str | None = None, **how) -> Dendrogram:
    """Points adjacent in their Delaunay triangulation."""
    return by_graph(df, G.delaunay(_points(df, id_col, run_key)), id_col, run_key=run_key, **how)


def by_distance(df: DataFrame, epsilon: float, id_col: str, *, run_key: str | None = None, **how) -> Dendrogram:
    """Points adjacent within a distance."""
    return by_graph(df, G.within_distance(_points(df, id_col, run_key), epsilon), id_col, run_key=run_key, **how)


def by_nearest(df: DataFrame, id_col: str, k: int = 3, *, run_key: str | None = None, **how) -> Dendrogram:
    """Points adjacent to their k - 1 nearest others, k counting the point itself."""
    return by_graph(df, G.nearest(_points(df, id_col, run_key), k), id_col, run_key=run_key, **how)


def by_polygons(df: DataFrame, id_col: str, adjacency: str = "rook", *, run_key: str | None = None, **how) -> Dendrogram:
    """Polygons adjacent along a piece of boundary (rook) or in a point (queen)."""
    S.require_kind(df, "polygon")
    return by_graph(df, S.polygon_neighbours(_keyed(df, id_col, run_key), adjacency), id_col, run_key=run_key, **how)


def by_lines(df: DataFrame, id_col: str, *, run_key: str | None = None, **how) -> Dendrogram:
    """Lines adjacent at their end points."""
    S.require_kind(df, "line")
    return by_graph(df, S.line_neighbours(_keyed(df, id_col, run_key)), id_col, run_key=run_key, **how)


def by_polygon_flows(zones: DataFrame, ods: DataFrame, id_col: str, zone: str, origin: str, destination: str, volume: str, *, adjacency: str = "rook", lam_in: float | None = None, lam_out: float | None = None, approx: bool = False) -> Dendrogram:
    """Polygons merged by how like their flows to and from all others are."""
    S.require_kind(zones, "polygon")
    z = _keyed(zones, id_col, None)
    keys = zones.select(F.lit(0).cast("bigint").alias("run_key"), F.col(id_col).cast("bigint").alias("id"), zone)
    f = O.triplets(ods, keys, origin=origin, destination=destination, volume=volume, zone=zone)
    return fit_flows(z.select("run_key", "id"), S.polygon_neighbours(z, adjacency), f, lam_in=lam_in, lam_out=lam_out, approx=approx)
