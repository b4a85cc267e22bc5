import numpy as np
import pytest
from pyspark.sql import functions as F

from contigua import api
from contigua.operators.dendrogram import cut


def sizes(t, k):
    return sorted(r["count"] for r in cut(t, k=k).groupBy("cl").count().collect())


def test_each_way_of_being_adjacent_finds_two_halves(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 8 + float(rng.uniform()) * 0.2, i // 8 + float(rng.uniform()) * 0.2, float((i >= 32) * 10 + rng.normal() * 0.1), "t") for i in range(64)]
    base = spark.createDataFrame(rows, "id bigint, px double, py double, v double, s string")
    pts = base.withColumn("geometry", F.struct(F.col("px").alias("x"), F.col("py").alias("y")))
    how = {"features": ["v"]}
    assert sizes(api.by_order(base, "id", "id", **how, scaling="zscore"), 2) == [32, 32]
    for t in (api.by_delaunay(pts, "id", **how), api.by_distance(pts, 1.6, "id", **how), api.by_nearest(pts, "id", 7, **how)):
        assert sizes(t, 2) == [32, 32]
    cx, cy = F.col("id") % 8, F.floor(F.col("id") / 8)
    at = lambda a, b: F.struct((cx + a).cast("double").alias("x"), (cy + b).cast("double").alias("y"))
    poly = base.withColumn("geometry", F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))))
    assert sizes(api.by_polygons(poly, "id", "queen", **how), 2) == [32, 32]
    # a comb: each line starts where the one before ends
    i = F.col("id").cast("double")
    line = base.withColumn("geometry", F.array(F.struct(i.alias("x"), F.lit(0.0).alias("y")), F.struct((i + 1).alias("x"), F.lit(0.0).alias("y"))))
    assert sizes(api.by_lines(line, "id", **how), 2) == [32, 32]
    half = F.col("id") >= 32
    ods = base.select(F.col("id").cast("string").alias("o"), half.alias("h")).join(base.select(F.col("id").cast("string").alias("d"), half.alias("h")), "h").where("o <> d").withColumn("n", F.lit(3.0))
    named = poly.withColumn("code", F.col("id").cast("string"))
    got = sizes(api.by_polygon_flows(named, ods, "id", "code", "o", "d", "n"), 2)
    assert len(got) == 2 and sum(got) == 64
    with pytest.raises(ValueError, match="point"):
        api.by_delaunay(poly, "id", **how)
    two = base.withColumn("half", half.cast("bigint"))
    assert sizes(api.by_order(two, "id", "id", run_key="half", **how), 1) == [64]
