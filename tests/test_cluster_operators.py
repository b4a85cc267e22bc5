"""Graphs, fits, dendrograms, geometry, flows, steps around a fit, and streams."""

import itertools
import math
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contigua.operators import dendrogram as D
from contigua.operators import fit
from contigua.operators import flows as O
from contigua.operators import geometry as S
from contigua.operators import graph as G
from contigua.operators import prep as P
from contigua.operators import sptree as T
from contigua.operators import workload as W
from contigua.operators.delaunay import _in_circle, triangulation_edges
from contigua.operators.fit import fit_chain, fit_flows, fit_graph
from contigua.plans import cluster_queries as CQ
from contigua.plans import fixtures as FX
from contigua.streaming.segments import level_shifts, recluster, tumbling


def edges_of(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def points(spark, p):
    return spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "run_key bigint, id bigint, x double, y double")


def square(x, y, w=1.0, h=1.0):
    return [[{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]


POLY = "run_key bigint, id bigint, geometry array<array<struct<x: double, y: double>>>"


def grid_polygons(spark, w):
    return spark.createDataFrame([(0, r * w + c, square(float(c), float(r))) for r in range(w) for c in range(w)], POLY)


def test_point_graphs_match_brute_force(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(size=(120, 2)), rng.uniform(size=(40, 2)) * 0.01, [[5, 5], [5, 5], [-3, 2]]])
    df = points(spark, p)
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    assert edges_of(G.within_distance(df, 0.1)) == {(i, j) for i, j in itertools.combinations(range(len(p)), 2) if d[i, j] <= 0.1 * 0.1}
    for k in (2, 4, 9):
        want = {tuple(sorted((i, j))) for i in range(len(p)) for j in sorted((j for j in range(len(p)) if j != i), key=lambda j: (d[i, j], j))[: k - 1]}
        assert edges_of(G.nearest(df, k)) == want
    assert G.nearest(df, 1).count() == 0
    assert len(edges_of(G.nearest(points(spark, p[:3]), 9))) == 3
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError, match="missing values"):
            G.nearest(points(spark, [[0, 0], [1, 1], [bad, 2]]), 2)


def test_nearest_among_crowds(spark):
    """A crowd in a corner of a wide plane, and very many points at one place."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.uniform(size=(20, 2)) * 1e6, rng.uniform(size=(300, 2)) * 1e-3, np.full((3000, 2), 7.0)])
    d = lambda i: ((p - p[i]) ** 2).sum(-1)
    want = set()
    for i in range(len(p)):
        order = np.lexsort((np.arange(len(p)), d(i)))
        want |= {tuple(sorted((i, int(j)))) for j in [j for j in order[:5] if j != i][:2]}
    assert edges_of(G.nearest(points(spark, p), 3)) == want


def test_components_of_long_paths_and_hubs(spark):
    nodes = spark.createDataFrame([(r, i) for r in (0, 1) for i in range(300)], "run_key bigint, id bigint")
    e = [(0, i, i + 1) for i in range(149)] + [(0, 299, i) for i in range(150, 299)] + [(1, 5, 5), (1, 7, 900), (1, 9, 8), (1, 8, 9)]
    edges = spark.createDataFrame(e, "run_key bigint, src bigint, dst bigint")
    got = {(r["run_key"], r["id"]): r["component"] for r in G.components(nodes, edges).collect()}
    assert all(got[0, i] == (0 if i < 150 else 150) for i in range(300)) and all(got[1, i] == (8 if i == 9 else i) for i in range(300))
    assert G.components(nodes.limit(0), edges).count() == 0 and G.components(nodes, edges.limit(0)).where("id <> component").count() == 0


def test_delaunay_has_empty_circles_and_handles_degenerate_points():
    rng = np.random.default_rng(1)
    q = rng.uniform(size=(40, 2))
    want = set()
    for a, b, c in itertools.combinations(range(40), 3):
        (ax, ay), (bx, by), (cx, cy) = q[a], q[b], q[c]
        if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) < 0:
            (bx, by), (cx, cy) = (cx, cy), (bx, by)
        if all(_in_circle(ax, ay, bx, by, cx, cy, *q[i]) <= 0 for i in range(40) if i not in (a, b, c)):
            want |= {(a, b), (a, c), (b, c)}
    assert set(map(tuple, triangulation_edges(q).tolist())) == want
    g = np.stack(np.meshgrid(np.arange(10), np.arange(10)), -1).reshape(-1, 2).astype(float)
    assert len(triangulation_edges(g)) == 180 + 81
    assert triangulation_edges(np.array([[0, 0], [2, 2], [1, 1.0]])).tolist() == [[0, 2], [1, 2]]
    assert triangulation_edges(np.array([[0, 0], [0, 0.0]])).tolist() == [[0, 1]] and len(triangulation_edges(np.zeros((1, 2)))) == 0


def test_polygons(spark):
    assert len(edges_of(S.polygon_neighbours(grid_polygons(spark, 10), "rook"))) == 180
    assert len(edges_of(S.polygon_neighbours(grid_polygons(spark, 10), "queen"))) == 342
    # a wide block over three small ones shares no whole segment with them; 4 overlaps 0, 5 touches a corner, 6 runs clockwise
    clock = [list(reversed(square(3.0, 0.0)[0]))]
    shapes = [square(0.0, 0.0), square(1.0, 0.0), square(2.0, 0.0), square(0.0, 1.0, 3.0), square(0.5, 0.5), square(-1.0, -1.0), clock]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(shapes)], POLY)
    rook = edges_of(S.polygon_neighbours(df, "rook"))
    assert rook == {(0, 1), (1, 2), (0, 3), (1, 3), (2, 3), (2, 6)}
    assert edges_of(S.polygon_neighbours(df, "queen")) == rook | {(0, 5), (3, 6)}
    with pytest.raises(ValueError):
        S.polygon_neighbours(df, "bishop")
    assert S.geometry_kind(df) == "polygon"
    with pytest.raises(ValueError):
        S.require_kind(df, "point")


def test_lines(spark):
    line = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    shapes = [line((0, 0), (1, 0)), line((1, 0), (2, 0)), line((1, 0), (0.5, 0)), line((1, 0), (0, 1), (0, 0)), line((0.5, -1), (0.5, 1)), line((1, 0), (2, 1), (1, 0)), line((2, 0), (1, 0), (0.5, 0.5), (1, 1))]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(shapes)], "run_key bigint, id bigint, geometry array<struct<x: double, y: double>>")
    # 2 lies on 0, 4 crosses it without an end in common, 5 is closed, 6 shares the end (2, 0) with 1 but lies on it
    assert edges_of(S.line_neighbours(df)) == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)}


def test_dissolve_and_holes(spark):
    df = grid_polygons(spark, 3)
    labels = df.select("run_key", "id", F.when(F.col("id") == 4, 2).otherwise(1).alias("cl"))
    got = {r["cl"]: r for r in S.dissolve_polygons(df, labels).withColumn("area", F.aggregate("geometry", F.lit(0.0), lambda a, r: a + S.ring_area(r))).collect()}
    assert got[1]["n"] == 8 and len(got[1]["geometry"]) == 2 and got[1]["area"] == 8.0 and got[2]["area"] == 1.0
    pts = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0)], "run_key bigint, id bigint, geometry double")
    assert S.dissolve_parts(pts, labels.where("id in (1, 2)")).first()["geometry"] == [5.0, 6.0]


def features(spark, x, run=0):
    return spark.createDataFrame([(run, i, i, [float(v) for v in np.atleast_1d(r)]) for i, r in enumerate(x)], "run_key bigint, id bigint, ord bigint, x array<double>")


def test_planted_grid_and_labels(spark):
    rng = np.random.default_rng(2)
    x = np.where(np.arange(100)[:, None] < 50, 5, -5) + rng.normal(size=(100, 2))
    x[0] = -5
    t = fit_graph(features(spark, x), S.polygon_neighbours(grid_polygons(spark, 10), "rook"))
    cl = {r["k"]: [] for r in D.cut(t, k=[2, 3]).select("k").distinct().collect()}
    for r in D.cut(t, k=[2, 3]).orderBy("k", "id").collect():
        cl[r["k"]].append(r["cl"])
    assert cl[3] == [1] + [2] * 49 + [3] * 50
    m = D.profiles(t, D.cut(t, k=3)).where("cl = 3").first()
    assert m["n"] == 50 and np.allclose(m["mean"], x[50:].mean(0)) and np.allclose(m["sum"], x[50:].sum(0))


def test_queen_joins_diagonals(spark):
    x = np.where(np.arange(100)[:, None] < 50, 5.0, -5.0) + np.zeros((100, 2))
    x[49], x[59] = -5, 5
    rook, queen = (fit_graph(features(spark, x), S.polygon_neighbours(grid_polygons(spark, 10), a)) for a in ("rook", "queen"))
    label = lambda t: {r["id"]: r["cl"] for r in D.cut(t, k=2).collect()}
    q, r = label(queen), label(rook)
    assert (q[49], q[59]) == (2, 1) and (r[49], r[59]) != (2, 1)


def test_grid_of_parts_whose_keys_have_gaps(spark, tmp_path):
    """Two copies of 50 parts, far apart in their keys, are one grid."""
    key = F.col("id") % 50 + F.floor(F.col("id") / 50) * 10**9
    spark.range(100).select(key.alias("p_partkey"), (F.col("id") * 37 % 11).cast("double").alias("p_retailprice"), (F.col("id") % 7).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in CQ.ward_grid_total(spark, str(tmp_path)).collect()] == [(0, 0.0)]
    cells = FX.grid(spark, str(tmp_path), ranked=True).select("row", "col").distinct().orderBy("row", "col").collect()
    assert [tuple(c) for c in cells] == [(r, c) for r in range(10) for c in range(10)]


def test_rows_of_long_runs_are_all_kept():
    n = 1_200_000
    ids, x = fit._once(np.arange(n), np.zeros((n, 1)))
    assert len(ids) == len(x) == n


def test_results_made_in_pieces_are_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    chain = lambda n: np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
    for name in ("ward", "bayes_mom"):
        runs = [fit._run(k, np.arange(n) + 100, rng.integers(1, 9, size=(n, 2)).astype(float), chain(n), fit.method_of(name)) for k, n in enumerate((1, 2, 30))]
        whole = pa.Table.from_batches(fit._batches(runs))
        assert whole.num_rows == 66 and whole["x"].null_count == whole["m"].null_count == 33 and whole["center"].null_count == whole["cost"].null_count == 36
        with monkeypatch.context() as m:
            m.setattr(fit, "BATCH", 7)
            pieces = list(fit._batches(runs))
        assert len(pieces) > 9 and pa.Table.from_batches(pieces).equals(whole)


def test_graph_of_many_batches_is_fitted_whole(spark):
    """A graph that is a chain, its edges reversed and repeated, over more rows than come to the task at once."""
    n = 25_000
    f = spark.range(n).select(F.lit(0).cast("bigint").alias("run_key"), "id", F.col("id").alias("ord"), F.array((F.col("id") * 7919 % 1009).cast("double")).alias("x"))
    e = spark.range(2 * n - 2).select(F.lit(0).cast("bigint").alias("run_key"), F.floor(F.col("id") / 2 + 1).alias("src"), F.floor(F.col("id") / 2).alias("dst"))
    merges = [t.merges.orderBy("m").toPandas() for t in (fit_graph(f, e), fit_chain(f))]
    assert len(merges[0]) == n - 1 and all((merges[0][c] == merges[1][c]).all() for c in ("m", "left", "right", "cost", "height", "size"))
    with pytest.raises(Exception, match="an edge has an end without features"):
        fit_graph(f, e.withColumn("dst", F.col("dst") - 1))


def test_runs_of_one_and_two_rows_and_repeats(spark):
    f = features(spark, [1.0]).unionByName(features(spark, [1.0, 3.0], 1)).unionByName(features(spark, [1.0, 3.0], 1))
    t = fit_chain(f)
    assert [tuple(r) for r in t.levels.orderBy("run_key", "m").select("run_key", "m", "k", "level").collect()] == [(0, 0, 1, 0.0), (1, 0, 2, 0.0), (1, 1, 1, 2.0)]
    assert D.cut(t, k=5).count() == 3 and D.segments(t).count() == 3 and D.best_k(t).count() == 2
    merges, members = D.collapse(t, 1)
    assert merges.count() == 0 and members.count() == 3
    assert [tuple(r) for r in D.signed_merges(t).select("a", "b").collect()] == [(-1, -2)]
    assert fit_chain(f.limit(0)).leaves.count() == 0


def test_collapse_and_front(spark):
    rng = np.random.default_rng(3)
    t = fit_chain(features(spark, np.cumsum(rng.normal(size=30))))
    merges, members = D.collapse(t, 6)
    at = {r["m"]: r for r in merges.collect()}
    flat = [at[m][c] for c in "ab" for m in sorted(at)]
    assert sorted(v for v in flat if v < 0) == [-6, -5, -4, -3, -2, -1] and sorted(v for v in flat if v > 0) == [1, 2, 3, 4]
    assert members.count() == 30 and {r["branch"] for r in members.collect()} == set(range(1, 7))
    cut = {r["id"]: r["cl"] for r in D.cut(t, k=6).collect()}
    assert len({(r["branch"], cut[r["id"]]) for r in members.collect()}) == 6
    rows = D.front(fit_chain(features(spark, np.repeat([0.0, 9, 1, 8], 10) + rng.normal(size=40)), "bayes_dgmm")).orderBy("k").collect()
    assert rows[0]["k"] == 1 and all(a["xend"] == b["x"] for a, b in zip(rows, rows[1:])) and abs(sum(r["share"] for r in rows) - 1) < 1e-9
    lines, branches = D.drawing(t, 6)
    assert lines.count() == 15 and [r["x"] for r in branches.orderBy("x").collect()] == [1, 2, 3, 4, 5, 6] and branches.agg(F.sum("size")).first()[0] == 30
    b = fit_chain(features(spark, np.repeat([0.0, 50, 1, 80], 10) + rng.normal(size=40)), "bayes_dgmm")
    assert D.drawing(b)[1].count() == D.best_k(b).first()["k"]
    h = D.cut(t, h=[-1.0, 1e9]).groupBy("cut").agg(F.count_distinct("cl").alias("n")).orderBy("cut").collect()
    assert [r["n"] for r in h] == [30, 1]
    with pytest.raises(ValueError):
        D.cut(t)


def test_tree_prior_matches_fit(spark):
    rng = np.random.default_rng(4)
    e = G.canonical_edges(spark.createDataFrame([(0, a - 1, b - 1) for a, b in [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (6, 7), (7, 6), (3, 3)]], "run_key bigint, src bigint, dst bigint"))
    t = fit_graph(features(spark, rng.uniform(size=(7, 2))), e, "bayes_dgmm")
    rows = T.tree_prior(t, e, 7).join(t.levels.select("k", "prior_intra", "prior_inter"), "k").orderBy("k").collect()
    assert abs(rows[0]["intra"] - math.log(9)) < 1e-9 and rows[0]["inter"] == 0
    assert all(abs(r["intra"] - r["prior_intra"]) < 1e-9 for r in rows)


def test_errors(spark):
    f = features(spark, [1.0, 2.0, 3.0])
    e = spark.createDataFrame([(0, 0, 1)], "run_key bigint, src bigint, dst bigint")
    with pytest.raises(Exception, match="not connected"):
        fit_graph(f, e)
    with pytest.raises(ValueError, match="not connected"):
        G.require_connected(f, e)
    with pytest.raises(Exception, match="missing values"):
        fit_chain(features(spark, [1.0, float("nan")]))
    with pytest.raises(ValueError, match="not recognized"):
        fit_chain(f, "nothing")
    df = spark.createDataFrame([(1, 1.0, "a", 2.0), (2, 2.0, "b", 2.0), (3, None, "c", 2.0)], "id bigint, v double, s string, w double")
    with pytest.raises(ValueError, match="missing values"):
        P.require_complete(df, ["v"])
    with pytest.raises(Exception, match="constant"):
        P.scaled(df, ["w"], "zscore").collect()
    with pytest.raises(ValueError):
        P.scaled(df, ["w"], "other")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert P.numeric_columns(df, ("id",)) == ["v", "w"] and len(w) == 1
    got = P.feature_table(df.where("v is not null"), "id", features=["v"], scaling="zscore").orderBy("id").collect()
    assert np.allclose([r["x"][0] for r in got], [-math.sqrt(0.5), math.sqrt(0.5)])


def test_flows(spark):
    zones = spark.createDataFrame([(1, " a"), (2, "b"), (3, "c"), (4, "d")], "id bigint, code string").withColumn("run_key", F.lit(0).cast("bigint"))
    ods = spark.createDataFrame([("a", "b", 5.0), ("a ", "b", 4.0), ("b", "a", 6.0), ("c", "d", 9.0), ("d", "c", 8.0), ("a", "x", 7.0), (None, "a", 1.0), ("a", "c", -1.0), ("a", "a", 2.0), ("b", "c", 1.0)], "o string, d string, v double")
    f = O.triplets(ods, zones, origin="o", destination="d", volume="v", zone="code")
    assert {(r["o"], r["d"]): r["vol"] for r in f.collect()} == {(1, 2): 9.0, (2, 1): 6.0, (3, 4): 9.0, (4, 3): 8.0, (1, 1): 2.0, (2, 3): 1.0}
    assert tuple(O.external(f, zones).first()) == (0, 33.0, 12)
    assert {r["id"]: (r["out_vol"], r["in_vol"], r["inside"]) for r in O.degrees(f).collect()}[1] == (11.0, 8.0, 2.0)
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "run_key bigint, src bigint, dst bigint")
    t = fit_flows(zones, e, f)
    assert {r["id"]: r["cl"] for r in D.cut(t, k=2).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_steps(spark):
    labels = spark.createDataFrame([(0, 2, i, 1 if i < 3 else 2) for i in range(6)], "run_key bigint, k int, id bigint, cl int")
    values = spark.createDataFrame([(0, i, float(i), i) for i in range(6)], "run_key bigint, id bigint, v double, ord bigint")
    ev = W.explained_variance(labels, values, "v").first()
    assert abs(ev["within"] - 2 / 3) < 1e-9 and abs(ev["share"] - (1 - 4 / 17.5)) < 1e-9
    assert [r["id"] for r in W.change_points(labels, values.select("run_key", "id", "ord")).collect()] == [3]
    assert abs(W.mutual_information(labels, labels.select("run_key", "id", F.col("cl").alias("truth"))).first()["nmi"] - 1) < 1e-9
    e = spark.createDataFrame([(0, i, i + 1) for i in range(5)], "run_key bigint, src bigint, dst bigint")
    gaps = values.select("run_key", "id", F.when(F.col("id") != 2, F.col("v")).alias("v"))
    assert W.fill_from_neighbours(gaps, e, "v").where("id = 2").first()["v"] == 2.0
    s = W.smooth_small(values.select("run_key", "id", "v", F.col("v").alias("n")), e, ["v"], "n", 2.0)
    assert [r["v"] for r in s.orderBy("id").collect()] == [1.0, 3.0, 2.0, 3.0, 4.0, 5.0]
    tr = W.track(labels.withColumn("cl", F.lit(7)), labels, values.select("run_key", "id", F.lit(1.0).alias("w")))
    assert {(r["cl"], r["from_cl"], r["overlap"]) for r in tr.collect()} == {(1, 7, 3.0), (2, 7, 3.0)}
    ts = spark.sql("select timestamp_ntz'1970-01-01 00:15:00' a, timestamp_ntz'1970-01-01 00:15:00.000001' b").select(W.ceiling_window(F.col("a"), 900), W.ceiling_window(F.col("b"), 900)).first()
    assert tuple(ts) == (900, 1800)
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "k bigint, D7T0H5 double, D8T24H0 double")
    assert {tuple(r) for r in W.wide_to_long(wide, "k").collect()} == {(1, 7, 0, 5, 2.0), (1, 8, 24, 0, 3.0)}
    grid = spark.createDataFrame([(0, i, t) for i in (1, 2) for t in (0, 1, 2)], "run_key bigint, id bigint, t int")
    assert edges_of(G.space_time(spark.createDataFrame([(0, 1, 2)], "run_key bigint, src bigint, dst bigint"), grid, 10)) == {(10, 20), (11, 21), (12, 22), (10, 11), (11, 12), (20, 21), (21, 22)}


def test_streams(spark, tmp_path):
    rows = [(1, f"2031-01-07 00:{i:02d}:00", 5.0 if i < 20 else 25.0) for i in range(40)]
    src = spark.createDataFrame(rows, "k bigint, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert [(r["n"], r["mean"]) for r in drain(level_shifts(stream(), "k", "t", "v", 10.0), "shifts")] == [(20, 5.0)]
    win = {r["start"].minute: r["n"] for r in drain(tumbling(stream(), "t", "k", "v", "10 minutes", "1 minute"), "win", "complete")}
    assert win == {0: 10, 10: 10, 20: 10, 30: 10}
    seen = []
    chains = stream().select(F.col("k").alias("run_key"), F.unix_seconds("t").alias("id"), F.col("t").alias("ord"), F.array("v").alias("x"))
    q = recluster(chains, lambda df, n: seen.extend(df.groupBy("cl").count().orderBy("cl").collect()), 2, checkpoint=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [r["count"] for r in seen] == [20, 20]
