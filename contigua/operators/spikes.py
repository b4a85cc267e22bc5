"""Implausible readings: impossible values, stuck runs, and spikes found by robust principal components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.operators.hot import DAY_US, hot_sources, wall_micros
from contigua.plans.shared import Kept

#: Readings on each side of a block that are repeated, so that runs over its edges are seen whole.
HALO = 16
#: Rounds in which far readings are left out of a scatter, and the least scatter in m/s.
TRIMS, LEAST_SCATTER = 4, 1e-3


@dataclass(frozen=True)
class SpikeRules:
    low: float = 0.0
    high: float = 55.0
    stuck_run: int = 6
    spike_run: int = 3
    least_jump: float = 4.0
    scatters: float = 8.0
    slot_minutes: int = 5
    block_rows: int = 20_000
    rounds: int = 12


def _pursuit(m: np.ndarray, seen: np.ndarray, scatter: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(course, low, sparse) of stacked matrices: the low-rank part at its full level and as shrunk in the last round, and the sparse part."""
    r, c = m.shape[1:]
    if r > c:
        course, low, sparse = _pursuit(m.transpose(0, 2, 1), seen.transpose(0, 2, 1), scatter, rounds)
        return course.transpose(0, 2, 1), low.transpose(0, 2, 1), sparse.transpose(0, 2, 1)
    tau = (scatter * (np.sqrt(r) + np.sqrt(c)))[:, None]
    gamma = (3.0 * scatter)[:, None, None]
    sparse = np.zeros_like(m)
    low = m
    for _ in range(rounds):
        full = np.where(seen, m - sparse, low)  # cells without a reading follow the low-rank part
        w, u = np.linalg.eigh(full @ full.transpose(0, 2, 1))
        s = np.sqrt(np.maximum(w, 0))
        gain = np.where(s > 0, np.maximum(s - tau, 0) / np.where(s > 0, s, 1), 0)
        low = (u * gain[:, None, :]) @ (u.transpose(0, 2, 1) @ full)
        rest = m - low
        sparse = np.where(seen, np.sign(rest) * np.maximum(np.abs(rest) - gamma, 0), 0)
    # what the shrinking of singular values took from the level is given back
    full = np.where(seen, m - sparse, low)
    w, u = np.linalg.eigh(full @ full.transpose(0, 2, 1))
    kept = u * (np.sqrt(np.maximum(w, 0)) > tau)[:, None, :]
    return kept @ (u.transpose(0, 2, 1) @ full), low, sparse


def robust_components(m: np.ndarray, seen: np.ndarray, scatter: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable principal component pursuit on a stack of matrices (g, r, c): m is about low-rank + sparse + noise.

    Minimises half the squared residual over the seen cells plus a nuclear norm of the low-rank part and an
    absolute norm of the sparse part, by turns; both weights follow from the noise `scatter` (g). The singular
    vectors come from Gram matrices of the short side, mostly days.
    """
    course, _, sparse = _pursuit(m, seen, scatter, rounds)
    return course, sparse


def _running_median(a: np.ndarray, half: int) -> np.ndarray:
    """Medians along the last axis over 2 * half + 1 cells, edges repeated."""
    wide = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(half, half)], mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=-1), axis=-1)


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and lengths of runs, `same` telling which rows continue the row before."""
    starts = np.flatnonzero(~same)
    return starts, np.diff(np.r_[starts, len(same)])


def _about_neighbours(x: np.ndarray, src: np.ndarray, day: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Each reading less the mean of the readings before and after it; NaN without both on its date, or where one of the three is to be skipped.

    The mean cancels a slow course and leaves 1.5 times the variance.
    """
    out = np.full(len(x), np.nan)
    if len(x) > 2:
        ok = (src[1:-1] == src[:-2]) & (src[1:-1] == src[2:]) & (day[1:-1] == day[:-2]) & (day[1:-1] == day[2:])
        ok &= ~(skip[1:-1] | skip[:-2] | skip[2:])
        out[1:-1] = np.where(ok, x[1:-1] - (x[:-2] + x[2:]) / 2, np.nan)
    return out


def _upper_median(size: np.ndarray, src: np.ndarray, n: int) -> np.ndarray:
    """Upper median by source; NaN for sources without a value."""
    order = np.lexsort((size, src))
    size, src = size[order], src[order]
    first, last = np.searchsorted(src, np.arange(n), "left"), np.searchsorted(src, np.arange(n), "right")
    return np.where(last > first, size[np.minimum(first + (last - first) // 2, max(len(size) - 1, 0))] if len(size) else 0.0, np.nan)


def _trimmed(rest: np.ndarray, src: np.ndarray, n: int, first: np.ndarray, few: int) -> np.ndarray:
    """Standard deviation of `rest` by source; values farther than 3.5 deviations are left out, in rounds that start from `first`.

    `first` stays where no more than `few` values are left.
    """
    sd = first
    for _ in range(TRIMS):
        use = np.abs(rest) <= 3.5 * sd[src]
        k = np.bincount(src[use], minlength=n)
        q = np.bincount(src[use], rest[use] ** 2, minlength=n)
        sd = np.where(k > few, np.maximum(np.sqrt(q / np.maximum(k, 1)), LEAST_SCATTER), first)
    return sd


def _trimmed_over(rows: DataFrame, first: DataFrame, few: int) -> DataFrame:
    """_trimmed of a distributed table (key, rest) by aggregation: (key, first, sd) from `first` (key, first), for the keys in `rows`."""
    sd = first.withColumn("sd", F.col("first"))
    near = F.abs("rest") <= 3.5 * F.col("sd")
    for _ in range(TRIMS):
        sums = rows.join(F.broadcast(sd), "key").groupBy("key", "first").agg(F.count_if(near).alias("k"), F.sum(F.when(near, F.col("rest") * F.col("rest"))).alias("q"))
        sd = sums.select("key", "first", F.when(F.col("k") > few, F.greatest(F.sqrt(F.col("q") / F.col("k")), F.lit(LEAST_SCATTER))).otherwise(F.col("first")).alias("sd"))
    return sd


def _upper_median_over(rows: DataFrame) -> DataFrame:
    """(key, middle): _upper_median of the absolute `rest` in a distributed table (key, rest), exactly.

    Values are counted in narrow bins first, and then one by one in the bin that holds the middle, so no task gets all rows of a key.
    """
    by_key = Window.partitionBy("key")
    sized = rows.select("key", F.abs("rest").alias("size")).withColumn("bin", F.floor(F.col("size") * 256))
    upto = by_key.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = sized.groupBy("key", "bin").agg(F.count("*").alias("had")).select("key", "bin", (F.sum("had").over(upto) - F.col("had")).alias("before"), "had", F.floor(F.sum("had").over(by_key) / 2).alias("at"))
    middle = bins.where("before <= at and at < before + had").select("key", "bin", (F.col("at") - F.col("before")).alias("at"))
    upto = by_key.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = sized.join(F.broadcast(middle), ["key", "bin"]).groupBy("key", "at", "size").agg(F.count("*").alias("had"))
    return values.withColumn("upto", F.sum("had").over(upto)).where("at < upto").groupBy("key").agg(F.min("size").alias("middle"))


def _cells(src: np.ndarray, day: np.ndarray, slot: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells (source, date, slot) of readings in their order: which cell each lies in, and each cell's first reading, median and count."""
    new = np.r_[True, (src[1:] != src[:-1]) | (day[1:] != day[:-1]) | (slot[1:] != slot[:-1])]
    cell = np.cumsum(new) - 1
    start, count = _runs(~new)
    v = x[np.lexsort((x, cell))]
    return cell, start, (v[start + (count - 1) // 2] + v[start + count // 2]) / 2, count


def _course(src: np.ndarray, day: np.ndarray, slot: np.ndarray, mid: np.ndarray, count: np.ndarray, scatter: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell (source, date, slot), in this order, its normal value and its low-rank part, from a matrix of each source.

    The matrix has a row for each day and a column for each slot and holds the medians of the cells' readings, whose noise
    follows from the `scatter` of readings and from how many of them cells hold. Sources with matrices of like size are stacked.
    """
    fresh = np.r_[True, (src[1:] != src[:-1]) | (day[1:] != day[:-1])]
    days = np.cumsum(fresh) - 1
    head = np.r_[True, src[1:] != src[:-1]]
    row = days - np.maximum.accumulate(np.where(head, days, 0))
    low_slot = np.full(n, 1 << 30)
    np.minimum.at(low_slot, src, slot)
    col = slot - low_slot[src]
    height, width = np.zeros(n, int), np.zeros(n, int)
    np.maximum.at(height, src, row + 1)
    np.maximum.at(width, src, col + 1)
    held = _upper_median(count, src, n)
    noise = scatter * np.sqrt(np.pi / (2 * held + np.pi - 2))  # that of a median: about the scatter's for one reading, 1.25 / sqrt(held) of it for many
    normal, low = np.empty(len(mid)), np.empty(len(mid))
    shape = np.where(height <= 4, 4, 1 << np.ceil(np.log2(np.maximum(height, 1))).astype(int)) * 10_000 + -(-width // 48) * 48
    for one in np.unique(shape[height > 0]):
        some = np.flatnonzero((shape == one) & (height > 0))
        r, c = int(one // 10_000), int(one % 10_000)
        for at in range(0, len(some), step := max(1, 400_000 // (r * c))):
            ids = some[at : at + step]
            place = np.full(n, -1)
            place[ids] = np.arange(len(ids))
            mine = place[src] >= 0
            g, i, j = place[src[mine]], row[mine], col[mine]
            m, seen = np.zeros((len(ids), r, c)), np.zeros((len(ids), r, c), bool)
            m[g, i, j] = mid[mine]
            seen[g, i, j] = True
            # start from the source's typical value in cells without a reading
            sums, cnt = m.sum(axis=(1, 2)), seen.sum(axis=(1, 2))
            m = np.where(seen, m, (sums / np.maximum(cnt, 1))[:, None, None])
            course, shrunk, _ = _pursuit(m, seen, noise[ids], rounds)
            normal[mine], low[mine] = _running_median(course, 4)[g, i, j], shrunk[g, i, j]
    return normal, low


def _course_of(cells: pa.Table, rules: SpikeRules) -> pa.Table:
    """_course of one source: (key, date, slot, normal, low) from its cells (key, date, slot, mid, n, first)."""
    cells = cells.sort_by([("date", "ascending"), ("slot", "ascending")])
    date, slot, mid, count, first = (cells[c].to_numpy() for c in ("date", "slot", "mid", "n", "first"))
    normal, low = _course(np.zeros(len(mid), int), date, slot, mid, count, first[:1], 1, rules.rounds)
    return pa.table({"key": cells["key"], "date": date, "slot": slot, "normal": normal, "low": low})


def _marks(x: np.ndarray, src: np.ndarray, day: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray]:
    """Which readings are impossible, and which are stuck."""
    begin = np.r_[True, (src[1:] != src[:-1]) | (day[1:] != day[:-1])]
    _, length = _runs(np.r_[False, (x[1:] == x[:-1]) & ~begin[1:]])
    return (x < rules.low) | (x > rules.high), np.repeat(length >= rules.stuck_run, length)


def _columns(blocks: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    return [blocks[c].to_numpy() for c in names]


def _sources(blocks: pa.Table) -> np.ndarray:
    """Numbers of the blocks that rows belong to."""
    key, part = _columns(blocks, ("key", "part"))
    return np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) - 1


def _regular(blocks: pa.Table, rules: SpikeRules) -> pa.Table:
    """(key, date, slot, x, rest, stuck) of the possible readings in the cores of whole blocks; rest is what they are from their neighbours' mean."""
    src = _sources(blocks)
    core, us, x = _columns(blocks, ("core", "us", "x"))
    impossible, stuck = _marks(x, src, us // DAY_US, rules)
    real = np.flatnonzero(~impossible)
    rest = _about_neighbours(x[real], src[real], us[real] // DAY_US, stuck[real])
    mine = core[real]
    at = real[mine]
    return blocks.select(["key", "date", "slot", "x"]).take(at).append_column("rest", pa.array(rest[mine], from_pandas=True)).append_column("stuck", pa.array(stuck[at]))


def _judge(blocks: pa.Table, rules: SpikeRules) -> pa.Table:
    """Kinds of the readings of whole blocks, ordered by (key, part, us, obs, x).

    normal, scatter, apart: of a hot source's readings, where part isn't 0, what _fit gives for ordinary sources.
    """
    src = _sources(blocks)
    obs, part, core, us, x, normal, scatter, apart = _columns(blocks, ("obs", "part", "core", "us", "x", "normal", "scatter", "apart"))
    by_id = np.lexsort((obs, src))  # stable: the first copy by time comes first
    once = np.empty(len(obs), bool)
    once[by_id] = np.r_[True, (obs[by_id[1:]] != obs[by_id[:-1]]) | (src[by_id[1:]] != src[by_id[:-1]])]
    src, obs, part, core, us, x, normal, scatter, apart = (a[once] for a in (src, obs, part, core, us, x, normal, scatter, apart))
    impossible, stuck = _marks(x, src, us // DAY_US, rules)
    real = np.flatnonzero(~impossible)
    spike, size, scale = np.zeros(len(x), bool), np.zeros(len(x)), np.zeros(len(x))
    if len(real):
        own = part[real] == 0
        if own.any():
            mine = real[own]
            normal[mine], scatter[mine], apart[mine] = _fit(src[mine], us[mine], x[mine], stuck[mine], rules)
        s, d, v, sd, apart = src[real], us[real] // DAY_US, x[real], scatter[real], apart[real]
        need = np.maximum(rules.least_jump, rules.scatters * sd)
        hit = np.zeros(len(v), bool)
        for k in range(1, rules.spike_run + 1):
            if len(v) < k + 2:
                break
            i = np.arange(1, len(v) - k)
            same = (s[i - 1] == s[i + k]) & (d[i - 1] == d[i + k])
            lo, hi, flagged = v[i], v[i], apart[i]
            for q in range(1, k):
                lo, hi, flagged = np.minimum(lo, v[i + q]), np.maximum(hi, v[i + q]), flagged & apart[i + q]
            jump = np.maximum(lo - np.maximum(v[i - 1], v[i + k]), np.minimum(v[i - 1], v[i + k]) - hi)
            for p in i[same & flagged & (jump >= need[i] - 1e-9)]:
                hit[p : p + k] = True
        spike[real], size[real], scale[real] = hit, v - normal[real], sd
    kind = np.where(impossible, "impossible", np.where(stuck, "stuck", "spike"))
    out = core & (impossible | stuck | spike)
    return pa.table({"obs_id": obs[out], "kind": kind[out], "deviation": size[out], "scatter": scale[out]})


def _fit(src: np.ndarray, us: np.ndarray, x: np.ndarray, stuck: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normal value, scatter, whether set apart) of the possible readings of whole sources; _fit_hot gives the same of distributed ones."""
    n, day, slot = int(src[-1]) + 1, us // DAY_US, (us % DAY_US) // (rules.slot_minutes * 60_000_000)
    rest = _about_neighbours(x, src, day, stuck)
    ok = np.isfinite(rest)
    first = np.maximum(_upper_median(np.abs(rest[ok]), src[ok], n) * 1.4826, LEAST_SCATTER)
    first = _trimmed(rest[ok], src[ok], n, first, 0) / np.sqrt(1.5)
    first = np.where(np.isfinite(first), first, LEAST_SCATTER)
    cell, start, mid, count = _cells(src, day, slot, x)
    normal, low = (a[cell] for a in _course(src[start], day[start], slot[start], mid, count, first, n, rules.rounds))
    apart = np.abs(x - low) > 3 * first[src]
    ok = ~apart & ~stuck
    sd = np.maximum(first, _trimmed((x - normal)[ok], src[ok], n, first, 8))[src]
    return normal, sd, apart | (np.abs(x - normal) > 3 * sd)


def _fit_hot(hot: DataFrame, regular: DataFrame, rules: SpikeRules) -> tuple[DataFrame, DataFrame]:
    """_fit of distributed sources from their possible readings, by aggregation: (key, date, slot, normal, low) and (key, first, scatter)."""
    rest = regular.where("rest is not null").select("key", "rest")
    start = _upper_median_over(rest).select("key", F.greatest(F.col("middle") * 1.4826, F.lit(LEAST_SCATTER)).alias("first"))
    about = _trimmed_over(rest, start, 0).select("key", (F.col("sd") / math.sqrt(1.5)).alias("first"))
    first = Kept(hot.select("key").join(F.broadcast(about), "key", "left").select("key", F.coalesce("first", F.lit(LEAST_SCATTER)).alias("first")), "scatter").df

    values = regular.groupBy("key", "date", "slot", "x").agg(F.count("*").alias("had"))
    in_cell = Window.partitionBy("key", "date", "slot")  # sorted with spilling, where a percentile would hold a cell's values in memory
    upto = F.sum("had").over(in_cell.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.select("key", "date", "slot", "x", upto.alias("upto"), F.sum("had").over(in_cell).alias("n"))
    middles = [F.min(F.when(F.col("upto") > F.expr(at), F.col("x"))) for at in ("(n - 1) div 2", "n div 2")]
    cells = ranked.groupBy("key", "date", "slot", "n").agg(((middles[0] + middles[1]) / 2).alias("mid"))
    course = cells.join(F.broadcast(first), "key").groupBy("key").applyInArrow(lambda t: _course_of(t, rules), f"key {dict(hot.dtypes)['key']}, date long, slot long, normal double, low double")
    course = Kept(course, "course").df

    usual = regular.where("not stuck").join(course, ["key", "date", "slot"]).join(F.broadcast(first), "key").where(F.abs(F.col("x") - F.col("low")) <= 3 * F.col("first"))
    fit = _trimmed_over(Kept(usual.select("key", (F.col("x") - F.col("normal")).alias("rest")), "usual").df, first, 8).select("key", "sd")
    return course, first.join(F.broadcast(fit), "key", "left").select("key", "first", F.greatest("first", "sd").alias("scatter"))


def _whole_blocks(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Blocks lie together in each partition; as many whole ones as reach `rows` rows come at once."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            whole = pa.Table.from_batches(held)
            last = np.searchsorted(src := _sources(whole), src[-1])
            if last:
                yield whole.slice(0, int(last))
            held = whole.slice(int(last)).combine_chunks().to_batches()
            count = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def implausible(readings: DataFrame, *, obs: str = "obs_id", source: str = "link_id", ts: str = "ts", value: str = "speed", rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(obs_id, kind, deviation, scatter) of the impossible, stuck and spiking readings of each source.

    Each source's readings form daily profile matrices (days by slots); robust principal components part them into
    low-rank normal behaviour, sparse spikes and noise. The source's scatter is the standard deviation of what they leave
    of the regular readings, or of readings about their neighbours' mean where that is larger: the first also holds slow
    wandering, the second doesn't take a course that the components miss for scatter. Readings set apart are then tested exactly: a spike is one to `spike_run` successive readings
    on one date on the same side of the reading before and the one after, by at least `least_jump` and `scatters` times the
    scatter. Constant runs and the range are tested apart from it.

    One shuffle brings each source's readings together, sorted by time. The readings of a source with more than
    `block_rows` of them are kept in the shared folder, numbered in pieces of slots, and cut into blocks of successive
    readings which overlap by HALO; its scatters and its cells' medians are aggregated over the cluster, in the same rounds.
    So no task gets the source whole, and how many readings it has decides where it is computed but not what comes out.

    Defined cases: readings without source, time or id are in no result, nor are those without a value (null, NaN or
    0), which are also passed over between neighbours; impossible ones are passed over for spikes. Copies of one id
    count once, as the first by time, then by value; readings with equal time are ordered by id. A source's first and last
    reading of a date is in no spike. An empty table gives no rows. Ids must be integers; other columns are not read.
    """
    v, t = F.col(f"`{value}`").cast("double"), F.col(f"`{ts}`")
    rows = readings.select(F.col(f"`{source}`").alias("key"), F.col(f"`{obs}`").alias("obs"), wall_micros(t).alias("us"), v.alias("x"))
    rows = rows.where("key is not null and obs is not null and us is not null and x is not null and not isnan(x) and x <> 0")

    hot = hot_sources(rows, "key", rules.block_rows)
    marked = rows.join(hot, "key", "left")
    fitted = {"normal": F.lit(float("nan")), "scatter": F.lit(float("nan")), "apart": F.lit(False)}
    plain = marked.where("n is null").select("key", F.lit(0).alias("part"), F.lit(True).alias("core"), "us", "obs", "x").withColumns(fitted)

    # hot sources, each reading once, in pieces of slots
    slot_us = rules.slot_minutes * 60_000_000
    finer = F.ceil(F.col("n") / (rules.block_rows * (DAY_US // slot_us)))
    times = {"date": F.floor(F.col("us") / DAY_US), "slot": F.floor(F.pmod("us", F.lit(DAY_US)) / slot_us), "piece": F.floor(F.pmod("us", F.lit(DAY_US)) * finer / slot_us)}
    crowded = Kept(marked.where("n is not null").groupBy("key", "obs", "n").agg(F.min(F.struct("us", "x")).alias("first")).select("key", "first.us", "obs", "first.x", "n").withColumns(times).drop("n"), "hot").df

    # numbers of their possible readings, and blocks of them with an overlap
    possible = F.col("x").between(rules.low, rules.high).cast("int")
    within = Window.partitionBy("key", "date", "piece").orderBy("us", "obs")
    numbered = crowded.withColumn("at", F.sum(possible).over(within.rowsBetween(Window.unboundedPreceding, 0)) - possible)
    pieces = crowded.groupBy("key", "date", "piece").agg(F.sum(possible).alias("had"))
    before = pieces.select("key", "date", "piece", (F.sum("had").over(Window.partitionBy("key").orderBy("date", "piece")) - F.col("had")).alias("before"))
    at = numbered.join(before, ["key", "date", "piece"]).withColumn("at", F.col("at") + F.col("before"))
    size = rules.block_rows
    parts = F.sequence(F.floor((F.greatest(F.col("at") - HALO, F.lit(0))) / size), F.floor((F.col("at") + HALO) / size))
    blocks = Kept(at.withColumn("part", F.explode(parts)).select("key", (F.col("part") + 1).cast("int").alias("part"), (F.floor(F.col("at") / size) == F.col("part")).alias("core"), "us", "obs", "x", "date", "slot"), "blocks").df

    # their normal course and scatter
    together = blocks.repartition("key", "part").sortWithinPartitions("key", "part", "us", "obs")
    schema = f"key {dict(rows.dtypes)['key']}, date long, slot long, x double, rest double, stuck boolean"
    regular = Kept(together.mapInArrow(lambda it: (b for t in _whole_blocks(it) for b in _regular(t, rules).to_batches()), schema), "regular").df
    course, scatter = _fit_hot(hot, regular, rules)
    off, low = F.abs(F.col("x") - F.col("normal")), F.abs(F.col("x") - F.col("low"))
    fitted["normal"], fitted["scatter"] = F.coalesce("normal", fitted["normal"]), F.coalesce("scatter", fitted["scatter"])
    fitted["apart"] = F.coalesce((low > 3 * F.col("first")) | (off > 3 * F.col("scatter")), F.lit(False))
    known = blocks.join(course, ["key", "date", "slot"], "left").join(F.broadcast(scatter), "key", "left").withColumns(fitted).select(plain.columns)

    together = plain.unionByName(known).repartition("key", "part").sortWithinPartitions("key", "part", "us", "obs", "x")
    return together.mapInArrow(lambda it: (b for t in _whole_blocks(it) for b in _judge(t, rules).to_batches()), "obs_id long, kind string, deviation double, scatter double")
