"""Consolidating pairwise matches into groups by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.plans.shared import Kept


#: Rows of the smaller side, in one partition, up to which a join builds a hash table of it instead of sorting both sides.
HASHED_ROWS = 1_000_000


def clean_edges(links: DataFrame, src: str, dst: str) -> DataFrame:
    """Undirected edges (lo < hi) without missing ends and loops; they may repeat."""
    a, b = F.col(f"`{src}`"), F.col(f"`{dst}`")
    return links.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi")


def _with_least(edges: DataFrame, least: DataFrame, key: str, total: int, hot_rows: int) -> DataFrame:
    """Edges with `m`, the least lower neighbour of their end `key`, or null if it has none.

    A key that holds more than max(hot_rows, total / 1000) edges is joined by broadcast, so that no task
    gets it whole. There are at most 1 000 of them. `least` has one row a key; while its share of a partition is
    small, it is hashed.
    """
    least = least.withColumnRenamed("hi", key)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total <= HASHED_ROWS * parts:
        least = least.hint("shuffle_hash")
    if total <= hot_rows:
        return edges.join(least, key, "left")
    bound = max(hot_rows, total // 1000)
    hot = [r[0] for r in edges.groupBy(key).count().where(F.col("count") > bound).select(key).collect()]
    if not hot:
        return edges.join(least, key, "left")
    is_hot: Column = F.col(key).isin(hot)
    spread = edges.where(is_hot).join(F.broadcast(least.where(is_hot)), key, "left")
    return edges.where(~is_hot).join(least.where(~is_hot), key, "left").unionByName(spread)


def _large_star(edges: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node's closed neighbourhood. As many edges as before."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    return _with_least(edges, least, "lo", total, hot_rows).select(F.coalesce("m", "lo").alias("lo"), "hi")


def _small_star(edges: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    below = _with_least(edges, least, "hi", total, hot_rows).where(F.col("lo") != F.col("m")).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return below.unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct()


def _leaves_marked(edges: DataFrame) -> DataFrame:
    """Distinct edges with `leaf`: whether their upper end has no other edge."""
    ends = edges.select(F.col("lo").alias("hi")).unionByName(edges.select("hi"))
    single = ends.groupBy("hi").agg(F.count("*").alias("degree")).where("degree = 1")
    return edges.join(single, "hi", "left").select("lo", "hi", F.col("degree").isNotNull().alias("leaf"))


def star_contraction(edges: DataFrame, *, hot_rows: int = 1_000_000) -> DataFrame:
    """(hi, lo) of edges (lo < hi): each node that isn't the least of its component, with the least.

    Large-star and small-star rewrites alternate, each an aggregation and a join, until no edge is left that they could
    change. After each pair the edges are written to the shared folder. A node that hangs on a lower one by its only edge
    gets what that one gets in the end, so such edges are set aside, and the rounds go on with the others: a component
    that has become a star costs nothing more. At last the nodes set aside take the group of the one they hung on, those
    of the last round first.

    Neither rewrite makes more edges than there were, so repeated ones are dropped once a round.
    """
    aside: list[Kept] = []
    sizes: list[int] = []
    now = edges.distinct()
    while True:
        kept = Kept(_leaves_marked(now), "edges")
        every, leaves = kept.df.agg(F.count("*"), F.count_if("leaf")).first()
        aside.append(kept)
        sizes.append(leaves)
        if every == leaves:
            break
        active = kept.df.where("not leaf").select("lo", "hi")
        now = _small_star(_large_star(active, every - leaves, hot_rows), every - leaves, hot_rows)

    found, steps = None, []
    for kept, size in zip(reversed(aside), reversed(sizes), strict=True):
        hung = kept.df.where("leaf").select("lo", "hi")
        if found is not None:
            hung = _with_least(hung, found.withColumnRenamed("lo", "m"), "lo", size, hot_rows).select(F.coalesce("m", "lo").alias("lo"), "hi")
        steps.append(Kept(hung, "groups"))
        found = steps[-1].df if found is None else found.unionByName(steps[-1].df)
    for kept in aside:
        kept.drop()
    return found


def group_ids(nodes: DataFrame, links: DataFrame, *, node_id: str = "id", src: str = "from", dst: str = "to", hot_rows: int = 1_000_000) -> DataFrame:
    """(id, group_id): for each distinct node the least node that links connect it to, directly or over others.

    Defined cases: null node ids give no row; a link with a missing end, an end that is no node, or both ends
    equal joins nothing, and repeated or reversed links count once; a node without links is its own group; empty
    tables give empty groups (no links: every node alone); other columns of either table are not read. Rows may be
    repeated. Ids may be of any ordered type that both tables share.
    """
    ids = nodes.select(F.col(f"`{node_id}`").alias("id")).where("id is not null").distinct()
    edges = clean_edges(links, src, dst)
    edges = edges.join(ids, edges.lo == ids.id, "left_semi")
    edges = edges.join(ids, edges.hi == ids.id, "left_semi")
    stars = star_contraction(edges, hot_rows=hot_rows).select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return ids.join(stars, "id", "left").select("id", F.coalesce("root", "id").alias("group_id"))
