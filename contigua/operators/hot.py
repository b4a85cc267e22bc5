"""Sources that hold very many rows, found by counting, so that they can be cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.plans.shared import Kept

DAY_US = 86_400_000_000
#: Most sources that are ever treated as hot; their list is collected and broadcast.
MOST = 500_000


def hot_sources(rows: DataFrame, key: str, least: int) -> DataFrame:
    """(key, n) of the at most MOST sources with the most rows among those with over `least` rows, counted once and broadcast.

    The bound holds at every size: beyond it a source has less than a 500 000th of all rows.
    """
    return F.broadcast(Kept(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), key).limit(MOST), "hot-sources").df)


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time as a wall clock shows it; its date doesn't depend on the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def day_piece(us: Column, pieces: Column) -> Column:
    """Which of `pieces` equal parts of the day a time lies in.

    The parts are equal in time, so readings that crowd into a moment stay together; they are sorted there, and can spill.
    """
    return F.floor(F.pmod(us, F.lit(DAY_US)) / 1_000_000 * pieces / 86_400).cast("int")
