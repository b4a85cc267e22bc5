"""Origin-destination flows between zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triplets(flows: DataFrame, zones: DataFrame, *, origin: str, destination: str, volume: str, zone: str, zone_id: str = "id") -> DataFrame:
    """(run_key, o, d, vol): volumes between zones by their ids, added over repeated pairs.

    Keys are compared without surrounding blanks; flows with an end that is no zone, or without a volume above 0, are dropped.
    Volumes are added by pairs of keys before they meet the zones.
    """
    v = F.col(f"`{volume}`").cast("double")
    summed = flows.select(F.trim(F.col(f"`{origin}`")).alias("ok"), F.trim(F.col(f"`{destination}`")).alias("dk"), v.alias("v")).where("v > 0 and not isnan(v)").groupBy("ok", "dk").agg(F.sum("v").alias("vol"))
    named = lambda key, out: zones.select(F.col("run_key") if "run_key" in zones.columns else F.lit(0).cast("bigint").alias("run_key"), F.trim(F.col(f"`{zone}`")).alias(key), F.col(zone_id).alias(out))
    both = summed.join(named("ok", "o"), "ok").join(named("dk", "d").withColumnRenamed("run_key", "run_key2"), "dk").where("run_key = run_key2")
    return both.groupBy("run_key", "o", "d").agg(F.sum("vol").alias("vol"))


def degrees(flows: DataFrame) -> DataFrame:
    """(run_key, id, out_vol, in_vol, inside): volumes from, to and within each zone; from and to count those within too."""
    ends = flows.select("run_key", F.explode(F.array(F.struct(F.col("o").alias("id"), F.col("vol").alias("out_vol"), F.lit(0.0).alias("in_vol"), F.when(F.col("o") == F.col("d"), F.col("vol")).otherwise(0.0).alias("inside")), F.struct(F.col("d").alias("id"), F.lit(0.0).alias("out_vol"), F.col("vol").alias("in_vol"), F.lit(0.0).alias("inside")))).alias("e"))
    return ends.select("run_key", "e.*").groupBy("run_key", "id").agg(F.sum("out_vol").alias("out_vol"), F.sum("in_vol").alias("in_vol"), F.sum("inside").alias("inside"))


def external(flows: DataFrame, zones: DataFrame) -> DataFrame:
    """(run_key, links, pairs): the volume between different zones, and the number of ordered pairs of zones."""
    n = zones.groupBy("run_key").agg((F.count("*") * (F.count("*") - 1)).alias("pairs"))
    e = flows.groupBy("run_key").agg(F.sum(F.when(F.col("o") != F.col("d"), F.col("vol")).otherwise(0.0)).alias("links"))
    return n.join(e, "run_key", "left").select("run_key", F.coalesce("links", F.lit(0.0)).alias("links"), "pairs")
