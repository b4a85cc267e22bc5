"""Components, clusters and packing against brute force, with hot keys and odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigua.llm.bisecting import Limits, alike_groups, bisect, typical_members
from contigua.llm.components import group_ids
from contigua.llm.packing import best_fit, pack, token_counts

LINKS = "`from` bigint, `to` bigint"


def brute_groups(nodes, links):
    root = {n: n for n in nodes if n is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(n, find(n)) for n in root}


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_groups_match_union_find(spark, hot):
    rng = random.Random(3)
    nodes = list(range(400))
    links = [(rng.randrange(420), rng.randrange(420)) for _ in range(180)]
    links += [(i, i + 1) for i in range(300, 360)] + [(399, i) for i in range(200, 290)]  # a chain and a hub
    links += links[:40] + [(b, a) for a, b in links[:40]] + [(None, 3), (5, None), (7, 7), (None, None)]
    n = spark.createDataFrame([(i,) for i in [*nodes, *nodes[:30], None]], "id bigint").withColumns({"lo": F.lit(1), "hi": F.lit("x"), "m": F.lit(None)})
    e = spark.createDataFrame(links, LINKS).withColumns({"lo": F.lit(9), "id": F.lit(0)})
    got = [tuple(r) for r in group_ids(n, e, hot_rows=hot).collect()]
    assert len(got) == 400 and set(got) == brute_groups(nodes, links)


def test_groups_of_nothing(spark):
    n, e = spark.createDataFrame([], "id bigint"), spark.createDataFrame([], LINKS)
    assert group_ids(n, e).count() == 0
    assert [tuple(r) for r in group_ids(spark.createDataFrame([(4,), (2,)], "id bigint"), e).orderBy("id").collect()] == [(2, 2), (4, 4)]


def test_a_long_chain_converges(spark):
    n = spark.range(1000)
    e = spark.range(999).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"))
    assert group_ids(n, e).where("group_id <> 0").count() == 0


# ---- clusters --------------------------------------------------------------------------------------------------------


def brute_alike(rows, distance, least=3):
    p = {}
    for i, *x in rows:
        if i is not None and all(v is not None and np.isfinite(v) and v > 0 for v in x):
            p[i] = min(p.get(i, tuple(x)), tuple(x))
    ids = sorted(p)
    x = np.array([p[i] for i in ids]).reshape(len(ids), -1)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= distance * distance
    out = set()
    for k in range(len(ids)):
        hood = np.flatnonzero(near[k])
        if len(hood) >= least and near[np.ix_(hood, hood)].all() and (near[hood].sum(1) == len(hood)).all():
            out.add((ids[k], ids[hood[0]]))
    return out


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c in range(25):
        centre, n = rng.uniform(5, 40, size=3), int(rng.integers(1, 40))
        for _ in range(n):
            v = rng.normal(size=3)
            rows.append((i, *(centre + v / np.linalg.norm(v) * rng.choice([0.2, 0.97, 1.05]) * (rng.uniform() if c % 2 else 1)).round(3).tolist()))
            i += 1
    rows += [(i + k, 60 + 0.5 * k, 60.0, 60.0) for k in range(12)]  # a chain, in which not all are alike
    rows += [(i + 20 + k, 80.0, 80.0, 80.0) for k in range(9)]  # equal values
    rows += [(i + 40, 80.0, 80.0, 82.0), (i + 41, 90.0, 90.0, 90.0), (i + 42, 90.0, 92.0, 90.0), (i + 43, 90.0, 91.0, 90.0), (i + 44, 92.001, 91.0, 90.0)]
    return rows + rows[:30] + [(9000, None, 1.0, 1.0), (9001, float("nan"), 1.0, 1.0), (9002, -1.0, 5.0, 5.0), (9003, float("inf"), 1.0, 1.0), (None, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_alike_groups_match_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "k bigint, D7 double, D8 double, D9 double").withColumns({"leaf": F.lit(1), "id": F.lit("q"), "x0": F.lit(0), "n": F.lit(2)})
    want = brute_alike(rows, 2.0)
    for limits in (None, Limits(1.0, 0.1, node_cells=60, block_rows=5)):  # splits across the cluster, and many blocks
        got = [tuple(r) for r in alike_groups(df, "k", ["D7", "D8", "D9"], 2.0, above=0.0, limits=limits).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_leaves_are_compact_and_whole(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "k bigint, D7 double, D8 double, D9 double")
    got = typical_members(df, "k", ["D7", "D8", "D9"], Limits(1.0, 0.1), above=0.0).collect()
    assert all(r["radius"] <= 1.0 + 1e-9 and r["distance"] <= r["radius"] + 1e-12 and r["rank"] <= 3 for r in got)
    assert sum({r["leaf"]: r["size"] for r in got}.values()) == len({r[0] for r in rows if r[0] is not None and r[0] < 9000})
    empty = df.limit(0)
    assert typical_members(empty, "k", ["D7"], Limits(1.0, 0.1)).count() == 0 and alike_groups(empty, "k", ["D7", "D8"], 2.0).count() == 0


def test_bisect_keeps_within_radius():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, size=(500, 2))
    leaf = bisect(np.ones(500), x, x, x, 1.0)
    for k in np.unique(leaf):
        m = x[leaf == k]
        assert np.sqrt(((m - m.mean(0)) ** 2).sum(1)).max() <= 1.0
    same = np.zeros((5, 2))
    assert len(np.unique(bisect(np.ones(5), same, same, same, 0.5))) == 1


# ---- packing ---------------------------------------------------------------------------------------------------------


def test_best_fit_fills_the_fullest_that_takes_it():
    got = best_fit([(4, [1]), (6, [2]), (3, [3]), (9, [4])], 10)  # sizes 6, 4, 7, 1
    assert sorted((f, sorted(m)) for f, m in got) == [(0, [1, 2]), (2, [3, 4])]


@pytest.mark.parametrize("kw", [{}, {"batch": 40, "fan_in": 2}])
def test_packing_is_whole_and_tight(spark, kw):
    rng = random.Random(1)
    sizes = [int(rng.paretovariate(0.9) * 20) for _ in range(1500)] + [100, 200, 201, 0, 50_000]
    rows = list(enumerate(sizes)) + [(None, 5), (3000, None), (3001, -4), (7, sizes[7])]
    df = spark.createDataFrame(rows, "item bigint, size bigint").withColumns({"free": F.lit(1), "members": F.lit("m"), "done": F.lit(False)}).repartition(6)
    got = pack(df, 200, **kw).collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
        pieces.setdefault(r["item"], []).append((r["first"], r["size"]))
    assert max(fill.values()) <= 200
    for i, s in enumerate(sizes):
        have = sorted(pieces.get(i, []))
        if i == 7:
            have = have[::2] if s <= 200 else have
        if s <= 200:
            assert have == ([(0, s)] if s else [])
        elif i != 7:
            assert [p[0] for p in have] == list(range(0, s, 200)) and sum(p[1] for p in have) == s
    total = sum(fill.values())
    assert total == sum(sizes) + sizes[7] and len(fill) <= 1.02 * total / 200 + 2


def test_items_over_half_are_never_lost(spark):
    df = spark.range(500).select(F.col("id").alias("item"), F.lit(110).alias("size"))
    for kw in ({}, {"batch": 50, "fan_in": 4}):
        got = pack(df, 200, **kw)
        assert got.count() == 500 and got.select("container_id").distinct().count() == 500
    assert pack(df.limit(0), 200).count() == 0
    with pytest.raises(ValueError):
        pack(df, 0)


def test_token_counts(spark):
    from contigua.llm.queries import TOKENIZER

    df = spark.createDataFrame([(1, "Ein Haus, two houses."), (2, ""), (3, None), (4, "a" * 50_000)], "doc_id bigint, text string")
    got = {r["item"]: r["size"] for r in token_counts(df, TOKENIZER).collect()}
    assert 4 <= got[1] <= 9 and got[2] == got[3] == 0 and got[4] > 1000
