"""Filling missing values from readings of the same source or time, with a mark, a method and a distance for each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.operators.hot import DAY_US, day_piece, hot_sources, wall_micros
from contigua.plans.shared import Kept


@dataclass(frozen=True)
class Numeric:
    """A numeric field, interpolated in time between the source's readings on one date.

    known: the value where there is one, else null. Null in a reading whose gap to the nearer neighbour exceeds
    `gap_s` seconds stays missing.
    """

    name: str
    known: Column
    gap_s: float = 86_400.0


@dataclass(frozen=True)
class Category:
    """A category, carried from the source's nearest reading that names it, if that is within `gap_s` seconds.

    Beyond the gap it is the source's most frequent value (ties: the least), if `by_source`; then the most frequent one of
    all readings on that date, if `by_date`; at last `default`.
    """

    name: str
    known: Column
    gap_s: float = 3_600.0
    by_source: bool = False
    by_date: bool = False
    default: Column | None = None


def _frequent(counts: DataFrame, key: str, name: str) -> DataFrame:
    """(key, value): the most frequent value of each key, from counts of rows."""
    by = counts.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.sum("n").alias("n"))
    return by.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(name).alias("value"))).alias("best")).select(key, F.col("best.value").alias(f"usual_{name}_{key}"))


def fill_missing(rows: DataFrame, *, source: str, ts: str, row_id: str, numerics: list[Numeric], categories: list[Category], piece_rows: int = 50_000) -> DataFrame:
    """(row id, source, time), and for each field: its value after filling, `<field>_filled`, `<field>_method`, `<field>_distance_s`.

    Rows of a source are ordered by time, and each missing field looks at the source's known neighbours before and after
    it. Numerics are interpolated between both (`interpolated`), or take the only one there is on that date (`previous`,
    `next`). The distance is the time to the nearer reading used, in seconds; null where a value comes from counts.

    Work is cut by source and date, and for a source with more than `piece_rows` rows by parts of the day too; what is
    known at the edges of a piece comes from one row for each piece, so that no task gets a hot source whole. The input is
    read three times: its sources are counted, its pieces summed up (and kept in the shared folder), its rows filled.

    Defined cases: rows without a source or time are kept, with only what `default` fills; rows may be repeated, each is
    filled; ties in time are ordered by row id; a field nothing is known of stays null, with `filled` false and no method;
    an empty table gives none. Other columns are not read, and may bear any name.
    """
    fields: list[Numeric | Category] = [*numerics, *categories]
    us = wall_micros(F.col(f"`{ts}`"))
    base = rows.select(F.col(f"`{source}`").alias("key"), F.col(f"`{row_id}`").alias("rid"), us.alias("us"), *[f.known.alias(f"v{i}") for i, f in enumerate(fields)])
    base = base.withColumn("date", F.floor(F.col("us") / DAY_US).cast("int"))
    placed = base.where("key is not null and us is not null")
    hot = hot_sources(placed, "key", piece_rows)
    loose = F.col("key").isNull() | F.col("us").isNull()
    # rows without a source or time have no neighbours: each is a piece of its own, wherever it lies
    piece = F.when(loose, F.xxhash64("rid")).otherwise(F.coalesce(day_piece(F.col("us"), F.ceil(F.col("n") / piece_rows)), F.lit(0)).cast("bigint"))
    pieces = base.join(hot, "key", "left").withColumn("piece", piece).drop("n")

    # what is known of each piece, counted before rows move: a row for each combination of categories in it
    cats = [i for i, f in enumerate(fields) if isinstance(f, Category)]
    nums = [i for i, f in enumerate(fields) if isinstance(f, Numeric)]
    when = {i: F.when(F.col(f"v{i}").isNotNull(), F.col("us")) for i in nums}
    ends = [(F.min, F.min_by, "first"), (F.max, F.max_by, "last")]
    aggs = [F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")]
    aggs += [c for i in nums for f, by, n in ends for c in (f(when[i]).alias(f"{n}{i}_t"), by(f"v{i}", when[i]).alias(f"{n}{i}_v"))]
    summary = Kept(pieces.where(~loose).groupBy("key", "date", "piece", *[f"v{i}" for i in cats]).agg(*aggs), "pieces").df

    # one row a piece: the first and last known reading of each field, carried over pieces
    def known(i: int, n: str) -> Column:
        if i in nums:
            return F.when(F.col(f"{n}{i}_t").isNotNull(), F.struct(F.col(f"{n}{i}_t").alias("t"), F.col(f"{n}{i}_v").alias("v")))
        return F.when(F.col(f"v{i}").isNotNull(), F.struct(F.col(f"{n}_us").alias("t"), F.col(f"v{i}").alias("v")))

    edges = summary.groupBy("key", "date", "piece").agg(*[f(known(i, n)).alias(f"{n}{i}") for i in range(len(fields)) for f, _, n in ends])
    carried = []
    for i, f in enumerate(fields):
        span = "key, date" if isinstance(f, Numeric) else "key"
        order = "piece" if isinstance(f, Numeric) else "date, piece"
        carried += [F.expr(f"lag(last{i}) ignore nulls over (partition by {span} order by {order})").alias(f"before{i}"), F.expr(f"lead(first{i}) ignore nulls over (partition by {span} order by {order})").alias(f"after{i}")]
    edges = edges.select("key", "date", "piece", *carried)
    for i, f in enumerate(fields):
        if isinstance(f, Category) and f.by_source:
            edges = edges.join(_frequent(summary, "key", f"v{i}"), "key", "left")
        if isinstance(f, Category) and f.by_date:
            edges = edges.join(_frequent(summary, "date", f"v{i}"), "date", "left")

    over = "over (partition by key, date, piece order by us, rid)"
    alone = "key is null or us is null"
    looked = pieces.join(edges, ["key", "date", "piece"], "left").withColumns(
        {f"{n}{i}": F.coalesce(F.expr(f"if({alone}, null, {fn}(if(v{i} is not null, named_struct('t', us, 'v', v{i}), null)) ignore nulls {over})"), F.col(f"{far}{i}")) for i in range(len(fields)) for n, fn, far in (("p", "lag", "before"), ("q", "lead", "after"))}
    )

    out: list[Column] = [F.col("rid").alias(row_id), F.col("key").alias(source), F.col("us")]
    for i, f in enumerate(fields):
        v, p, q = F.col(f"v{i}"), F.col(f"p{i}"), F.col(f"q{i}")
        back, ahead = (F.col("us") - p["t"]) / 1e6, (q["t"] - F.col("us")) / 1e6
        use_p, use_q = p.isNotNull() & (back <= f.gap_s), q.isNotNull() & (ahead <= f.gap_s)
        near = F.least(F.when(use_p, back), F.when(use_q, ahead))
        if isinstance(f, Numeric):
            share = F.when(back + ahead > 0, back / (back + ahead)).otherwise(0.0)
            steps = [("interpolated", p.isNotNull() & q.isNotNull() & (use_p | use_q), p["v"] + (q["v"] - p["v"]) * share, near), ("previous", use_p, p["v"], back), ("next", use_q, q["v"], ahead)]
        else:
            steps = [("previous", use_p & (~use_q | (back <= ahead)), p["v"], back), ("next", use_q, q["v"], ahead)]
            steps += [("source", F.col(f"usual_v{i}_key").isNotNull(), F.col(f"usual_v{i}_key"), F.lit(None))] * f.by_source
            steps += [("date", F.col(f"usual_v{i}_date").isNotNull(), F.col(f"usual_v{i}_date"), F.lit(None))] * f.by_date
            steps += [("default", f.default.isNotNull(), f.default, F.lit(None))] if f.default is not None else []

        def pick(at: int, steps: list = steps) -> Column:
            """What the first step that holds has at place `at`."""
            return reduce(lambda rest, step: F.when(step[1], step[at] if at else F.lit(step[0])).otherwise(rest), reversed(steps), F.lit(None))

        method = F.when(v.isNull(), pick(0))
        out += [F.coalesce(v, pick(2)).alias(f.name), method.isNotNull().alias(f"{f.name}_filled"), method.cast("string").alias(f"{f.name}_method"), F.when(v.isNull(), pick(3)).cast("double").alias(f"{f.name}_distance_s")]
    return looked.select(*out)
