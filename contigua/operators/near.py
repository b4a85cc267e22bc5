"""Points near other points: overlapping strips of latitude, each swept with a longitude-ordered active set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.plans.shared import Kept

#: Candidate pairs that a sweep compares at once.
BLOCK = 2_000_000
#: Most slabs of one strip. With more rows at one latitude slabs grow, and are still swept row by row.
MOST_SLABS = 8_192


def _bounds(rows: DataFrame, col: str, parts: int) -> np.ndarray:
    """Distinct inner quantiles that cut the rows into about `parts` ranges."""
    if parts < 2:
        return np.zeros(0)
    return np.unique(rows.approxQuantile(col, [i / parts for i in range(1, parts)], 0.2 / parts))


def _slab_bounds(rows: DataFrame, tile_rows: int) -> dict[int, np.ndarray]:
    """For each crowded strip of rows (strip, x) the quantiles of x that cut it, all from one grouped aggregation."""
    crowded = {r["strip"]: r["n"] for r in rows.groupBy("strip").agg(F.count("*").alias("n")).where(F.col("n") > 2 * tile_rows).collect()}
    if not crowded:
        return {}
    slabs = min(1 << (max(crowded.values()) // tile_rows).bit_length(), MOST_SLABS)
    share = F.array(*[F.lit(i / slabs) for i in range(1, slabs)])
    cut = rows.where(F.col("strip").isin(list(crowded))).groupBy("strip").agg(F.percentile_approx("x", share, F.lit(10 * slabs)).alias("cuts"))
    return {r["strip"]: np.unique(r["cuts"]) for r in cut.collect()}


def _pairs(cur: tuple, act: tuple, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Id pairs of points of `cur` with earlier points of the active set `act` (both (x, y, id)) within the radius."""
    order = np.argsort(act[0], kind="stable")
    ax, ay, ai = (c[order] for c in act)
    cx, cy, ci = cur
    lo, hi = np.searchsorted(ax, cx - radius * (1 + 1e-9), "left"), np.searchsorted(ax, cx + radius * (1 + 1e-9), "right")
    n, at = hi - lo, 0
    ends = np.cumsum(n)
    while at < len(n):
        # as many current points as BLOCK candidates allow; a single point's active range may be cut as well
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        for off in range(0, int(n[at:stop].max(initial=0)), BLOCK):
            k = np.clip(n[at:stop] - off, 0, BLOCK)
            who = np.repeat(np.arange(at, stop), k)
            other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:stop] + off, k)
            earlier = (ay[other] < cy[who]) | ((ay[other] == cy[who]) & (ai[other] < ci[who]))
            near = earlier & ((ax[other] - cx[who]) ** 2 + (ay[other] - cy[who]) ** 2 <= radius * radius)
            if near.any():
                yield ci[who[near]], ai[other[near]]
        at = stop


def _sweep(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Rows ordered by tile and y. Only points at most `radius` below the current ones stay in the active set."""
    tile, act = None, None
    for batch in batches:
        t = batch.column("tile").to_numpy()
        rows = [batch.column(c).to_numpy() for c in ("x", "y", "id")] + [batch.column("home").to_numpy(zero_copy_only=False)]
        cuts = np.flatnonzero(np.diff(t)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(t)], strict=True):
            if a == b:
                continue
            if t[a] != tile:
                tile, act = t[a], tuple(np.empty(0, r.dtype) for r in rows[:3])
            y = rows[1]
            while a < b:
                stop = min(b, max(a + 1, int(np.searchsorted(y[a:b], y[a] + radius, "right")) + a))
                part = tuple(r[a:stop] for r in rows[:3])
                keep = act[1] >= part[1][0] - radius * (1 + 1e-9)
                act = tuple(np.concatenate([o[keep], p]) for o, p in zip(act, part, strict=True))
                home = rows[3][a:stop]
                for one, two in _pairs(tuple(p[home] for p in part), act, radius):
                    yield pa.record_batch({"id_a": np.minimum(one, two), "id_b": np.maximum(one, two)})
                a = stop


def _placer(ybounds: np.ndarray, slabs: dict[int, np.ndarray], radius: float):
    """Rows (id, x, y) in each tile that they touch, by binary search in the bounds; home marks the tile that a row lies in."""
    wide = radius * (1 + 1e-9)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y"))
            if not len(i):
                continue
            strip, upper = np.searchsorted(ybounds, y, "right"), np.searchsorted(ybounds, y + wide, "right")
            times = upper - strip + 1
            who = np.repeat(np.arange(len(i)), times)
            at = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + strip[who]
            slab, first, last = (np.zeros(len(who), np.int64) for _ in range(3))
            for s in np.intersect1d(at, list(slabs)) if slabs else ():
                here = at == s
                for out, shift in ((slab, 0.0), (first, -wide), (last, wide)):
                    out[here] = np.searchsorted(slabs[int(s)], x[who[here]] + shift, "right")
            times = last - first + 1
            more = np.repeat(np.arange(len(who)), times)
            of = np.arange(len(more)) - np.repeat(np.cumsum(times) - times, times) + first[more]
            w, a = who[more], at[more]
            yield pa.record_batch({"id": i[w], "x": x[w], "y": y[w], "tile": a * MOST_SLABS + of, "home": (a == strip[w]) & (of == slab[more])})

    return place


def near_pairs(points: DataFrame, radius: float, *, id_col: str = "id", x: str = "x", y: str = "y", zero_is_missing: bool = True, tile_rows: int = 100_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: points whose Euclidean distance is at most `radius`, each pair once.

    The points are read once and kept in the shared folder, each id once. Latitude (y) is cut at approximate quantiles into
    strips of about `tile_rows` points. A point also goes to the strips that begin less than `radius` above it. A strip that
    still holds more than twice `tile_rows` (many equal latitudes) is cut again along x in the same way, with overlap on
    both sides; the bounds of all of them come from one aggregation. Each tile is sorted by y and swept with an active set
    ordered by x; a pair belongs to the tile that is home to its later point by (y, id).

    Only the bounds go to the workers: a number for every `tile_rows` points.

    Defined cases: a point has no position, and is in no pair, if id, x or y is null, x or y is NaN or infinite, or, with
    zero_is_missing, both are 0. Repeated rows count once; of several positions of one id the least (x, y) counts.
    Points at one place are all near each other. An empty table gives no pairs. Other columns are not read.
    """
    spark = points.sparkSession
    px, py = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    rows = points.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), px.alias("x"), py.alias("y")).where("id is not null and abs(x) < double('infinity') and abs(y) < double('infinity')")
    if zero_is_missing:
        rows = rows.where("not (x = 0 and y = 0)")
    rows = Kept(rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "points").df

    total = rows.count()
    parts = max(1, -(-total // tile_rows), min(spark.sparkContext.defaultParallelism, total // 1000))
    ybounds = _bounds(rows, "y", parts)
    wide = float(radius)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"strip": np.searchsorted(ybounds, b.column("y").to_numpy(), "right"), "x": b.column("x")})

    slabs = _slab_bounds(rows.mapInArrow(strips, "strip long, x double"), tile_rows) if total > 2 * tile_rows else {}
    tiles = rows.mapInArrow(_placer(ybounds, slabs, wide), "id long, x double, y double, tile long, home boolean")
    count = len(ybounds) + 1 + sum(map(len, slabs.values()))
    tiles = tiles.repartition(max(1, min(count, 16_384)), "tile").sortWithinPartitions("tile", "y", "id")
    return tiles.mapInArrow(lambda it: _sweep(it, wide), "id_a long, id_b long")
