"""Segmenting streams: chains that arrive in order of event time are cut again with each batch, or followed by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contigua.operators.dendrogram import cut
from contigua.operators.fit import fit_chain
from contigua.operators.hot import wall_micros


def recluster(stream: DataFrame, write: Callable[[DataFrame, int], None], k: int, method: object = "ward", checkpoint: str | None = None):
    """A streaming query that fits each micro-batch's chains (run_key, id, ord, x) and hands their labels to `write`."""

    def each(batch: DataFrame, number: int) -> None:
        write(cut(fit_chain(batch, method), k=k), number)

    w = stream.writeStream.foreachBatch(each)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def tumbling(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and means by key and tumbling window of event time; readings later than `late` are dropped.

    Times without a zone are taken as a wall clock shows them, and so are the windows' ends.
    """
    if dict(stream.dtypes)[ts] != "timestamp_ntz":
        return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")
    as_utc = stream.withColumn(ts, F.timestamp_micros(wall_micros(F.col(ts))))
    found = tumbling(as_utc, ts, key, value, width, late)
    wall = lambda c: (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros(c) / 1_000_000)).alias(c)
    return found.select(key, wall("start"), wall("end"), "n", "mean")


def level_shifts(stream: DataFrame, key: str, ts: str, value: str, jump: float) -> DataFrame:
    """(key, start, n, mean): segments of each key that end when a value leaves the segment's mean by more than `jump`.

    State is the open segment's start, count and sum, so it stays small however long a segment grows.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, total = state.get if state.exists else (None, 0, 0.0)
        done = []
        for pdf in batches:
            for t, v in pdf.sort_values(ts)[[ts, value]].dropna().itertuples(index=False):
                if n and abs(v - total / n) > jump:
                    done.append((k[0], pd.Timestamp(start, unit="us"), n, total / n))
                    n = 0
                if not n:
                    start, total = int(pd.Timestamp(t).value // 1000), 0.0
                n, total = n + 1, total + float(v)
        if n:
            state.update((start, n, total))
        yield pd.DataFrame(done, columns=[key, "start", "n", "mean"])

    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, start timestamp, n bigint, mean double", "start bigint, n bigint, total double", "append", GroupStateTimeout.NoTimeout)
