"""Inputs of the queries: chains, points, grids, profiles, networks, zones and flows, from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.sources.tables import table

#: The counts of a supplier's lines by return flag and line status.
CELLS = [("A", "F"), ("N", "F"), ("N", "O"), ("R", "F"), ("A", "O"), ("R", "O")]
#: Keys that are ranked together.
BLOCK = 65_536
MODES = ["nodep", "marche", "velo", "drm", "voiture", "tcom"]


def single(c: str = "run_key") -> Column:
    """The key of tables that are one run."""
    return F.lit(0).cast("bigint").alias(c)


def chains(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each user in order of time, with their value."""
    return table(spark, folder, "events").select(F.col("user_id").alias("run_key"), F.col("event_id").alias("id"), F.col("ts").alias("ord"), F.array("value").alias("x"), "value", "event_type")


def points(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(single(), F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.transform(F.slice(e, 3, 62), lambda v: v.cast("double")).alias("features"), "label")


def _ranks(parts: DataFrame) -> DataFrame:
    """The rank r of each part's key from 0 on, counted in blocks of keys."""
    keys = parts.select("p_partkey").distinct().withColumn("block", F.floor(F.col("p_partkey") / BLOCK))
    before = keys.groupBy("block").agg(F.count("*").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    return keys.join(before, "block").select("p_partkey", (F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("p_partkey")) - 1).alias("r"))


def grid(spark: SparkSession, folder: str, ranked: bool = False) -> DataFrame:
    """Parts as cells of a square grid, by how far their key is from the least; or, where keys have gaps, by its rank, so that the grid has none."""
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size")
    size = parts.agg(F.min("p_partkey").alias("low"), F.floor(F.sqrt(F.count("*"))).alias("w"))
    r = F.col("r") if ranked else F.col("p_partkey") - F.col("low")
    placed = parts.join(_ranks(parts), "p_partkey") if ranked else parts
    return placed.crossJoin(F.broadcast(size)).select(single(), F.col("p_partkey").alias("id"), F.pmod(r, F.col("w")).alias("col"), F.floor(r / F.col("w")).alias("row"), F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")).alias("x"))


def cells(spark: SparkSession, folder: str, ranked: bool = False) -> DataFrame:
    """The grid as unit squares."""
    at = lambda dx, dy: F.struct((F.col("col") + dx).cast("double").alias("x"), (F.col("row") + dy).cast("double").alias("y"))
    return grid(spark, folder, ranked).select("run_key", "id", "x", F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))).alias("geometry"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers in order of key, with the counts of their lines in six cells and the composition that half counts more make."""
    lines = table(spark, folder, "lineitem")
    counts = lines.groupBy("l_suppkey").agg(*[F.count_if((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b)).cast("double").alias(f"c{i}") for i, (a, b) in enumerate(CELLS)])
    all_c = [F.col(f"c{i}") for i in range(len(CELLS))]
    whole = sum(all_c, F.lit(0.5 * len(CELLS)))
    return counts.select(single(), F.col("l_suppkey").alias("id"), F.col("l_suppkey").alias("ord"), F.array(*all_c).alias("counts"), F.array(*[(c + 0.5) / whole for c in all_c]).alias("shares"))


def roads(spark: SparkSession, folder: str) -> DataFrame:
    """Links with both ends at surveyed nodes, as straight lines; the least row of each link."""
    n = table(spark, folder, "nodes").where("x is not null and y is not null and not isnan(x) and not isnan(y) and not (x = 0 and y = 0)").groupBy("id").agg(F.min(F.struct("x", "y")).alias("p"))
    links = table(spark, folder, "links").groupBy("link_id").agg(F.min(F.struct("from", "to", "length_m")).alias("l")).select("link_id", "l.*")
    placed = links.join(n.withColumnsRenamed({"id": "from", "p": "a"}), "from").join(n.withColumnsRenamed({"id": "to", "p": "b"}), "to")
    return placed.where("a.x <> b.x or a.y <> b.y").select(single(), F.col("link_id").alias("id"), F.array("a", "b").alias("geometry"))


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Zones numbered in order of their code; there are 400 of them at every scale."""
    z = table(spark, folder, "zones")
    return z.withColumn("id", F.row_number().over(Window.orderBy("CODE_IRIS")).cast("bigint")).withColumn("run_key", single())


def consecutive(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Each row (run_key, id, cols) beside the next of its run: (run_key, src, dst, a_col, b_col)."""
    w = Window.partitionBy("run_key").orderBy("ord", "id")
    nxt = F.lead(F.struct("id", *cols)).over(w)
    return rows.withColumn("__next", nxt).where("__next is not null").select("run_key", F.col("id").alias("src"), F.col("__next.id").alias("dst"), *[F.col(c).alias(f"a_{c}") for c in cols], *[F.col(f"__next.{c}").alias(f"b_{c}") for c in cols])
