"""Filling fixed-capacity containers: best fit in each partition, then tree merges of what stays underfull."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.plans.shared import Kept

#: Splits a text before byte pairs are merged; a fixed value that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMBER = pa.struct([("item", pa.int64()), ("first", pa.int64()), ("size", pa.int64())])
BIN = pa.schema([("free", pa.int64()), ("members", pa.list_(MEMBER)), ("done", pa.bool_())])
BIN_DDL = "free bigint, members array<struct<item: bigint, first: bigint, size: bigint>>, done boolean"


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The byte-pair encoding of a file of ranks (base64 token, rank); no special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, ranks: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, size): tokens of each whole text. Null texts have none. The file of ranks must be on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for b in batches:
            yield pa.record_batch({"item": b.column(0), "size": pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())})

    return documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "item bigint, size bigint")


def best_fit(bins: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """(free, members) merged by best-fit decreasing: each goes, whole, to the fullest container that takes it."""
    room: list[tuple[int, int]] = []  # (free, place in out), in order
    out: list[list] = []
    for free, members in sorted(bins, key=lambda b: (b[0], b[1])):
        used = capacity - free
        at = bisect_left(room, (used, -1))
        if at < len(room):
            left, k = room.pop(at)
            out[k][0] = left - used
            out[k][1] = out[k][1] + members
            if left > used:
                insort(room, (left - used, k))
        else:
            out.append([free, members])
            if free:
                insort(room, (free, len(out) - 1))
    return [(f, m) for f, m in out]


def _pack(bins: list[tuple[int, list]], capacity: int, slack: int) -> pa.RecordBatch:
    packed = best_fit(bins, capacity)
    return pa.record_batch([[f for f, _ in packed], [m for _, m in packed], [f <= slack for f, _ in packed]], schema=BIN)


def pack(items: DataFrame, capacity: int, *, item: str = "item", size: str = "size", slack_share: float = 0.005, batch: int = 50_000, fan_in: int = 8) -> DataFrame:
    """(container_id, item, first, size, place): what each container holds, `first` being an item's first unit in it.

    An item that exceeds the capacity is split in full containers and a rest; no other is split. Each partition packs its
    items by best fit, in runs of at most `batch`, and emits containers with at most `slack_share` unused. Underfull
    containers are merged as whole items by rounds: the partitions of a round are `fan_in` times fewer than before, but
    never so few that one gets over `batch` containers. The rounds end with one partition, or when a round at the bound
    merges less than one container in a hundred. Each round's containers are written to the shared folder.

    container_id numbers the written containers; ids are unique but have gaps.

    Defined cases: null items or sizes and sizes below 1 are in no container; equal sizes are placed in order of item;
    a repeated item (same id) is packed as often as it comes, and told apart by container and place; an empty table
    gives none; other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    slack = int(capacity * slack_share)
    rows = items.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{size}`").cast("bigint").alias("size"))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []
        for b in batches:
            for i, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i is None or n is None or n < 1:
                    continue
                whole = n // capacity
                for start in range(0, whole, 10_000):
                    part = range(start, min(whole, start + 10_000))
                    yield pa.record_batch([[0] * len(part), [[{"item": i, "first": k * capacity, "size": capacity}] for k in part], [True] * len(part)], schema=BIN)
                if rest := n % capacity:
                    held.append((capacity - rest, [(i, n - rest, rest)]))
            if len(held) >= batch:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(bins: list[tuple[int, list]]) -> pa.RecordBatch:
        return _pack(bins, capacity, slack)

    def next_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []
        for b in batches:
            held += [(f, [(m["item"], m["first"], m["size"]) for m in ms]) for f, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if len(held) >= batch:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    level = Kept(rows.mapInArrow(first_round, BIN_DDL), "bins")
    done = [level.df.where("done")]
    parts, rest = None, level.df.where("not done")
    left = rest.count()
    while left and parts != 1:
        bound = -(-left // batch)
        parts = max(bound, (parts or fan_in * max(1, min(1024, left // 1000))) // fan_in, 1)
        # spread by free room, so that each partition gets all sizes
        merged = Kept(rest.select("free", "members").repartition(parts, F.xxhash64("free", "members")).mapInArrow(next_round, BIN_DDL), "bins")
        done.append(merged.df.where("done"))
        rest = merged.df.where("not done")
        before, left = left, rest.count()
        if parts == bound and left > before * 0.99:
            break
    done.append(rest)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    named = bins.withColumn("container_id", F.monotonically_increasing_id()).select("container_id", F.posexplode("members").alias("place", "m"))
    return named.select("container_id", F.col("m.item").alias("item"), F.col("m.first").alias("first"), F.col("m.size").alias("size"), "place")
