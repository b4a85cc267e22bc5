"""Near pairs, implausible readings and filling: brute force on random data, hot groups, and the defined odd cases."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from contigua.operators.fill import Category, Numeric, fill_missing
from contigua.operators.near import near_pairs
from contigua.operators.spikes import SpikeRules, implausible, robust_components

NAN = float("nan")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute_near(rows, r):
    p = {}
    for i, x, y in rows:
        if i is not None and x is not None and y is not None and math.isfinite(x) and math.isfinite(y) and (x, y) != (0, 0):
            p[i] = min(p.get(i, (x, y)), (x, y))
    ids = sorted(p)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (p[a][0] - p[b][0]) ** 2 + (p[a][1] - p[b][1]) ** 2 <= r * r}


def test_near_pairs_random_and_odd(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-100, 100), rng.choice([rng.uniform(-100, 100), 7.0, 7.0])) for i in range(600)]
    rows += [(1000 + i, 5.0, 5.0) for i in range(20)] + [(2000, None, 1.0), (2001, NAN, 1.0), (2002, 0.0, 0.0), (2003, 0.0, -0.0), (None, 1.0, 1.0), (2004, float("inf"), 1.0)]
    rows += rows[:50] + [(3, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double").withColumns({"tile": F.lit(1), "strip": F.lit("s"), "home": F.lit(None), "slab": F.lit(2), "count": F.lit(0)})
    want = brute_near(rows, 6.0)
    for tile in (100_000, 60, 20):  # small tiles: many strips, and strips cut along x
        assert pairs(near_pairs(df, 6.0, tile_rows=tile)) == want


def test_near_pairs_radius_is_closed_and_strips_are_thinner_than_it(spark):
    rows = [(i, 0.0, i * 0.5 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    assert pairs(near_pairs(df, 25.0, tile_rows=10)) == brute_near(rows, 25.0)


def test_near_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, x double, y double")
    assert near_pairs(empty, 5.0).count() == 0
    assert near_pairs(spark.createDataFrame([(1, 2.0, 3.0)], empty.schema), 5.0).count() == 0


# ---- readings --------------------------------------------------------------------------------------------------------

T0 = dt.datetime(2031, 1, 7)


def readings(seed, links=6, slots=90):
    rng = np.random.default_rng(seed)
    rows, obs = [], 0
    for link in range(links):
        level, sd = rng.uniform(8, 25), rng.uniform(0.1, 1.2)
        for day in range(3):
            for s in range(slots):
                obs += 1
                v = round(float(level + 4 * math.sin(s / 15) + rng.normal() * sd), 2)
                rows.append([obs, link, T0 + dt.timedelta(days=day, minutes=5 * s, seconds=float(rng.uniform(0, 299))), v])
    for _ in range(40):
        rows[rng.integers(len(rows))][3] = float(rng.choice([-3, 0, 70, NAN, 30, 2, 26]))
    for _ in range(8):
        at = int(rng.integers(len(rows) - 9))
        for k in range(int(rng.integers(4, 9))):
            rows[at + k][3] = 11.11
    for _ in range(25):
        at, k = int(rng.integers(len(rows) - 4)), int(rng.integers(1, 5))
        for j in range(k):
            rows[at + j][3] = round(rows[at + j][3] + float(rng.choice([9, -7, 14])), 2)
    return [tuple(r) for r in rows]


def brute_implausible(rows):
    """All rules by plain loops; scatter as the operator defines it."""
    out, by, seen = set(), {}, set()
    for o, link, ts, v in sorted((r for r in rows if r[1] is not None and r[3] is not None and not math.isnan(r[3]) and r[3] != 0), key=lambda r: (r[1], r[2], r[0])):
        if (link, o) not in seen:
            seen.add((link, o))
            by.setdefault(link, {}).setdefault(ts.date(), []).append((o, v))
    for days in by.values():
        stuck, d = set(), []
        for g in days.values():
            out |= {o for o, v in g if v < 0 or v > 55}
            i = 0
            while i < len(g):
                j = i
                while j < len(g) and g[j][1] == g[i][1]:
                    j += 1
                if j - i >= 6:
                    stuck |= {o for o, _ in g[i:j]}
                i = j
        out |= stuck
        for g in days.values():
            g = [(o, v) for o, v in g if 0 <= v <= 55]
            d += [v2 - (v1 + v3) / 2 for (o1, v1), (o2, v2), (o3, v3) in zip(g, g[1:], g[2:]) if not {o1, o2, o3} & stuck]
        d = np.array(d)
        sd = max(np.sort(np.abs(d))[len(d) // 2] * 1.4826, 1e-3) if len(d) else 1e-3
        for _ in range(4):
            use = d[np.abs(d) <= 3.5 * sd]
            sd = max(np.sqrt((use**2).mean()), 1e-3) if len(use) else sd
        sd /= math.sqrt(1.5)
        for g in days.values():
            g = [(o, v) for o, v in g if 0 <= v <= 55]
            for k in (1, 2, 3):
                for i in range(1, len(g) - k):
                    b, a, run = g[i - 1][1], g[i + k][1], [v for _, v in g[i : i + k]]
                    jump = max(min(run) - max(a, b), min(a, b) - max(run))
                    if jump >= max(4, 8 * sd) - 1e-9:
                        out |= {o for o, _ in g[i : i + k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "obs_id bigint, link_id bigint, ts timestamp_ntz, speed double")


def test_implausible_matches_plain_rules(spark):
    for seed in (1, 2):
        rows = readings(seed)
        rows += rows[::9] + [(10**6, None, T0, 99.0), (10**6 + 1, 1, T0, None), (10**6 + 2, 1, None, 80.0)]
        random.Random(seed).shuffle(rows)
        df = frame(spark, rows).withColumns({"key": F.lit(1), "part": F.lit("p"), "x": F.lit(None), "n": F.lit(3), "date": F.lit(0), "core": F.lit(False)})
        got = implausible(df).select("obs_id").collect()
        have = {r[0] for r in got}
        want = brute_implausible([r for r in rows if r[2] is not None])
        assert len(got) == len(have)
        # a normal reading between two spikes isn't apart from its course, though the plain rule alone would take it
        assert have <= want and len(want - have) <= 4


def test_hot_source_is_cut_without_loss(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 7, T0 + dt.timedelta(seconds=30 * i), round(float(15 + 3 * math.sin(i / 300) + rng.normal() * 0.3), 2)) for i in range(4000)]
    for at in range(50, 4000, 97):
        k = at % 3 + 1
        for j in range(k):
            rows[at + j] = (*rows[at + j][:3], 28.5 + j)
    for at in range(70, 4000, 331):
        for j in range(7):
            rows[at + j] = (*rows[at + j][:3], 14.2)
    for at in range(10, 4000, 50):
        rows[at] = (*rows[at][:3], 60.0)
    df = frame(spark, rows)
    whole = {tuple(r) for r in implausible(df).select("obs_id", "kind").collect()}
    for block in (300, 97):
        cut = {tuple(r) for r in implausible(df, rules=SpikeRules(block_rows=block)).select("obs_id", "kind").collect()}
        # each block has a scatter of its own, but what is planted is far from any of them
        assert cut == whole and len(whole) > 100


def test_components_decide(spark):
    """What the neighbours' rule alone takes for spikes stays where the components see normal behaviour, and hot sources are fitted over whole days."""
    rng = np.random.default_rng(11)
    rows, obs = [], 0
    walk = 0.0
    for day in range(4):
        for slot in range(280):
            # readings that wander about their course: their neighbours are near, the course is far
            walk = 0.75 * walk + rng.normal() * 0.9
            rows.append((obs := obs + 1, 1, T0 + dt.timedelta(days=day, minutes=5 * slot), round(float(20 + walk), 3)))
    plain = np.array([r[3] for r in rows])
    middle = plain[1:-1] - (plain[:-2] + plain[2:]) / 2
    near = float(np.median(np.abs(middle)) * 1.4826 / math.sqrt(1.5))
    at, jump = 400, 1.2 * 8 * near
    assert jump > 4 and 8 * plain.std() > 2 * jump * 0.8
    rows[at] = (*rows[at][:3], max(rows[at - 1][3], rows[at + 1][3]) + jump)
    assert implausible(frame(spark, rows)).count() == 0
    # the same jump in readings that keep to their course
    still = [(o, 2, t, round(float(20 + rng.normal() * near / 2), 3)) for o, _, t, _ in rows]
    still[at] = (*still[at][:3], max(still[at - 1][3], still[at + 1][3]) + jump)
    for block in (20_000, 500):
        assert [r["obs_id"] for r in implausible(frame(spark, still), rules=SpikeRules(block_rows=block)).collect()] == [still[at][0]]


def test_size_of_source_changes_nothing(spark):
    """Ids, kinds, deviations and scatters are the same whether sources are judged in one task or cut into blocks; copies with other times or values too."""
    rng = np.random.default_rng(5)
    rows, obs = [], 0
    for link, (step, noise, n) in enumerate([(20, 0.4, 1500), (300, 0.6, 700), (7, 1.1, 1500), (900, 0.3, 300)], 1):
        walk = 0.0
        for i in range(n):
            walk = 0.8 * walk + rng.normal() * noise
            rows.append([obs := obs + 1, link, T0 + dt.timedelta(seconds=step * i), round(float(18 + 4 * math.sin(i * step / 9000) + walk), 2)])
    for _ in range(150):
        at, jump = int(rng.integers(len(rows) - 3)), float(rng.normal() * 7)
        for k in range(int(rng.integers(1, 4))):
            rows[at + k][3] = round(rows[at + k][3] + jump, 2)
    for at in rng.integers(len(rows) - 7, size=8):
        for k in range(7):
            rows[at + k][3] = 11.11
    for at in rng.integers(len(rows), size=30):
        rows[at][3] = float(rng.choice([-3.0, 70.0, 0.0, NAN]))
    rows += [[o, link, t + dt.timedelta(seconds=500 * (k % 3)), x + k % 2] for k, (o, link, t, x) in enumerate(rows[::29])]
    df = frame(spark, [tuple(r) for r in rows])
    whole, *cuts = ({(r["obs_id"], r["kind"]): (r["deviation"], r["scatter"]) for r in implausible(df, rules=SpikeRules(block_rows=block)).collect()} for block in (20_000, 1000, 97))
    assert {kind for _, kind in whole} == {"impossible", "stuck", "spike"}
    for cut in cuts:
        assert cut.keys() == whole.keys()
        assert all(np.allclose(cut[k], whole[k], rtol=0, atol=1e-9) for k in whole)


def test_implausible_of_nothing(spark):
    assert implausible(frame(spark, [])).count() == 0
    assert implausible(frame(spark, [(1, 1, T0, 60.0), (2, 1, T0, 5.0), (3, 2, T0, NAN)])).select("obs_id", "kind").collect() == [(1, "impossible")]


def test_components_part_spikes_from_profiles():
    rng = np.random.default_rng(0)
    base = 15 + 4 * np.sin(np.arange(96) / 10)
    m = np.stack([base, base * 1.1, base * 0.9]) + rng.normal(size=(3, 96)) * 0.2
    m[1, 40] += 9
    low, sparse = robust_components(m[None], np.ones((1, 3, 96), bool), np.array([0.2]), 12)
    assert abs(sparse[0, 1, 40]) > 5 and np.abs(low[0] - m).mean() < 1 and (sparse[0] != 0).sum() < 10


# ---- filling ---------------------------------------------------------------------------------------------------------


def filled(df, **kw):
    return fill_missing(
        df,
        source="s",
        ts="t",
        row_id="i",
        numerics=[Numeric("v", F.when(~F.isnan("v"), F.col("v")))],
        categories=[Category("c", F.col("c"), gap_s=600, by_source=True), Category("d", F.col("d"), gap_s=600, by_date=True, default=F.lit("none"))],
        **kw,
    )


def test_fill_interpolates_and_carries(spark):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    rows = [(1, 1, m(0), 10.0, "a", "x"), (2, 1, m(5), None, None, None), (3, 1, m(20), 30.0, None, None), (4, 1, m(30), NAN, None, "y"), (5, 1, m(60 * 30), None, None, None), (6, 2, m(1), None, None, None), (7, None, m(1), 4.0, None, None), (8, 1, None, None, "a", None)]
    df = spark.createDataFrame(rows, "i bigint, s bigint, t timestamp_ntz, v double, c string, d string").withColumns({"key": F.lit(0), "piece": F.lit(0), "us": F.lit("u"), "v0": F.lit(1)})
    got = {r["i"]: r for r in filled(df).collect()}
    assert len(got) == 8
    assert got[2]["v"] == 15.0 and got[2]["v_method"] == "interpolated" and got[2]["v_distance_s"] == 300
    assert got[4]["v"] == 30.0 and got[4]["v_method"] == "previous" and got[4]["v_distance_s"] == 600
    assert got[5]["v"] is None and not got[5]["v_filled"] and got[5]["v_method"] is None  # no reading on its date
    assert got[6]["v"] is None and got[6]["c"] is None
    assert got[2]["c"] == "a" and got[2]["c_method"] == "previous"
    assert got[3]["c"] == "a" and got[3]["c_method"] == "source" and got[3]["c_distance_s"] is None
    assert got[3]["d"] == "y" and got[3]["d_method"] == "next"
    assert got[6]["d"] in ("x", "y") and got[6]["d_method"] == "date"
    assert got[5]["d"] == "none" and got[5]["d_method"] == "default" and got[7]["d"] == "none" and got[1]["d_filled"] is False


def test_fill_hot_source_is_the_same_in_pieces(spark):
    rng = random.Random(2)
    rows = [(i, 1, T0 + dt.timedelta(seconds=i * 60), rng.choice([None, float(rng.randint(1, 50))]), rng.choice([None, None, "a", "b"]), None) for i in range(2500)]
    df = spark.createDataFrame(rows + rows[:100], "i bigint, s bigint, t timestamp_ntz, v double, c string, d string")
    whole = sorted(tuple(r) for r in filled(df).na.fill(-1).collect())
    assert sorted(tuple(r) for r in filled(df, piece_rows=60).na.fill(-1).collect()) == whole


def test_fill_of_nothing(spark):
    assert filled(spark.createDataFrame([], "i bigint, s bigint, t timestamp_ntz, v double, c string, d string")).count() == 0
