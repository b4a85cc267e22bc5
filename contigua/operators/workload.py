"""Steps around a fit: reshaping, smoothing, filling, profiles, quality, change points and tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.operators.graph import both_ways


def wide_to_long(wide: DataFrame, key: str, pattern: str = r"^D(\d+)T(\d+)H(\d+)$") -> DataFrame:
    """(key, day, hour, minute, value) from columns named by day and time, such as D7T8H30. A value that is not a number is null."""
    import re

    cols = [c for c in wide.columns if re.search(pattern, c)]
    long = wide.unpivot([key], cols, "name", "value")
    part = lambda g: F.regexp_extract("name", pattern, g).cast("int")
    return long.select(key, part(1).alias("day"), part(2).alias("hour"), part(3).alias("minute"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def ceiling_window(ts: Column, seconds: int) -> Column:
    """The end of the slot of `seconds` that a time lies in; a time on a boundary belongs to the slot that ends there."""
    from contigua.operators.hot import wall_micros

    step = seconds * 1_000_000
    return (F.ceil(wall_micros(ts) / step) * seconds).cast("bigint")


def log_ratio(cols: list[str], base: str) -> list[Column]:
    """Additive log ratios of counts against a base count, each raised by one."""
    return [(F.log(F.col(c) + 1) - F.log(F.col(base) + 1)).alias(f"alr_{c}") for c in cols]


def row_shares(cols: list[str]) -> list[Column]:
    """Percentages of the row's total; null where the total is 0."""
    whole = sum((F.col(c) for c in cols), F.lit(0.0))
    return [F.when(whole != 0, F.col(c) / whole * 100).alias(f"pct_{c}") for c in cols]


def smooth_small(rows: DataFrame, edges: DataFrame, cols: list[str], total: str, least: float) -> DataFrame:
    """Counts of rows (run_key, id, ...) whose total is below `least` become sums over the row and its neighbours, all at once."""
    around = both_ways(edges).join(rows.select("run_key", F.col("id").alias("dst"), *cols, total), ["run_key", "dst"]).groupBy("run_key", F.col("src").alias("id")).agg(*[F.sum(c).alias(f"near_{c}") for c in [*cols, total]])
    both = rows.join(around, ["run_key", "id"], "left")
    small = F.coalesce(F.col(total), F.lit(0)) < least
    return both.withColumns({c: F.when(small, F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(F.col(f"near_{c}"), F.lit(0.0))).otherwise(F.col(c)) for c in [*cols, total]}).drop(*[f"near_{c}" for c in [*cols, total]])


def fill_from_neighbours(rows: DataFrame, edges: DataFrame, col: str) -> DataFrame:
    """A missing value becomes the mean of its neighbours' values, or else the mean of all."""
    near = both_ways(edges).join(rows.select("run_key", F.col("id").alias("dst"), F.col(col).alias("v")), ["run_key", "dst"]).groupBy("run_key", F.col("src").alias("id")).agg(F.avg("v").alias("near"))
    whole = rows.groupBy("run_key").agg(F.avg(col).alias("whole"))
    return rows.join(near, ["run_key", "id"], "left").join(whole, "run_key").withColumn(col, F.coalesce(F.col(col), "near", "whole")).drop("near", "whole")


def explained_variance(labels: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """(run_key, k, within, share): variance within clusters, weighted by size, and the share of the total that it leaves explained."""
    both = labels.join(values.select("run_key", "id", F.col(col).alias("v")), ["run_key", "id"])
    by = both.groupBy("run_key", "k", "cl").agg(F.count("v").alias("n"), F.var_pop("v").alias("s"), F.avg("v").alias("m"))
    ss, n = F.sum(F.col("n") * F.col("s")), F.sum("n")
    whole = ss + F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / n
    return by.groupBy("run_key", "k").agg((ss / n).alias("within"), F.when(whole > 0, 1 - ss / whole).alias("share"))


def change_points(labels: DataFrame, order: DataFrame) -> DataFrame:
    """(run_key, k, id, ord): rows whose cluster is another than that of the row before, by order (run_key, id, ord)."""
    w = Window.partitionBy("run_key", "k").orderBy("ord", "id")
    both = labels.join(order, ["run_key", "id"])
    return both.withColumn("before", F.lag("cl").over(w)).where("before is not null and before <> cl").select("run_key", "k", "id", "ord")


def mutual_information(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(run_key, k, nmi): mutual information of clusters and classes (run_key, id, truth), divided by the larger entropy."""
    counts = labels.join(truth, ["run_key", "id"]).groupBy("run_key", "k", "cl", "truth").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run_key", "k")
    rows = counts.withColumns({"all": F.sum("n").over(w), "a": F.sum("n").over(Window.partitionBy("run_key", "k", "cl")), "b": F.sum("n").over(Window.partitionBy("run_key", "k", "truth"))})
    p = F.col("n") / F.col("all")
    sums = rows.groupBy("run_key", "k").agg(F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(-p * F.log(F.col("a") / F.col("all"))).alias("ha"), F.sum(-p * F.log(F.col("b") / F.col("all"))).alias("hb"))
    top = F.greatest("ha", "hb")
    return sums.select("run_key", "k", F.when(top > 0, F.col("mi") / top).otherwise(1.0).alias("nmi"))


def track(before: DataFrame, after: DataFrame, weight: DataFrame) -> DataFrame:
    """(run_key, cl, from_cl, overlap): for each cluster of a later cut the earlier cluster it shares the most weight with.

    Cuts are (run_key, id, cl), weights (run_key, id, w); of equal overlaps the lower number counts.
    """
    both = after.select("run_key", "id", "cl").join(before.select("run_key", "id", F.col("cl").alias("from_cl")), ["run_key", "id"]).join(weight, ["run_key", "id"])
    shared = both.groupBy("run_key", "cl", "from_cl").agg(F.sum("w").alias("overlap"))
    best = shared.groupBy("run_key", "cl").agg(F.max(F.struct("overlap", -F.col("from_cl"))).alias("b"))
    return best.select("run_key", "cl", (-F.col("b.col2")).alias("from_cl"), F.col("b.overlap").alias("overlap"))


def signed_rank(pairs: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """(key, n, v, z, p): the paired signed-rank test of `one` being greater than `two` in each group.

    Pairs with a missing value or without a difference are left out; equal sizes share their mean rank. z has the
    corrections for continuity and ties. p is exact for fewer than 50 pairs of different sizes, else by the normal curve.
    """
    import math

    import numpy as np
    import pandas as pd

    d = pairs.select(key, (F.col(one) - F.col(two)).cast("double").alias("d")).where("d <> 0 and not isnan(d)")
    sizes = d.groupBy(key, F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(key).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", below + (F.col("t") + 1) / 2)
    t, n = F.col("t"), F.col("n")
    by = ranked.groupBy(key).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("v"), F.sum(t * t * t - t).alias("ties"))
    rows = by.withColumn("z", (F.col("v") - n * (n + 1) / 4 - 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))

    def chance(batches):
        for pdf in batches:
            out = []
            for n, v, z, ties in pdf[["n", "v", "z", "ties"]].itertuples(index=False):
                if ties or n >= 50:
                    out.append(0.5 * math.erfc(z / math.sqrt(2)))
                else:
                    ways = np.ones(1)
                    for k in range(1, int(n) + 1):
                        ways = np.r_[ways, np.zeros(k)] + np.r_[np.zeros(k), ways]
                    out.append(float(ways[int(round(v)) :].sum() / 2.0**n))
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "v": pdf["v"], "z": pdf["z"], "p": out})

    return rows.select(key, "n", "v", "z", "ties").mapInPandas(chance, f"{key} {dict(pairs.dtypes)[key]}, n bigint, v double, z double, p double")
