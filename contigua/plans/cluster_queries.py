"""Queries of graph building, merging, priors and dendrograms, with SQL of the same result or of an invariant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contigua.functions import vectors as V
from contigua.functions.special import lgamma_col, log_add
from contigua.operators import dendrogram as D
from contigua.operators import flows as O
from contigua.operators import geometry as S
from contigua.operators import graph as G
from contigua.operators import prep as P
from contigua.operators import sptree as T
from contigua.operators import workload as W
from contigua.operators.fit import fit_chain, fit_flows, fit_graph
from contigua.plans import fixtures as X
from contigua.plans import tree_sql as M
from contigua.sources.tables import table
from contigua.types import Method

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The segments of each user's chain in the flagship query.
SEGMENTS = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def steady(c: str) -> Column:
    """Five decimals, off the ties that halves of values with few decimals make; the SQL does the same."""
    return F.round(F.col(c) + 3.3e-7, 5).alias(c)


# ---- graphs ----------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS run_key, least(event_id, n) AS src, greatest(event_id, n) AS dst
    FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL""")
def edges_chain(spark, folder):
    return G.chain(X.chains(spark, folder), ["ord", "id"])


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    r AS (SELECT a.id AS s, b.id AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS r FROM p a JOIN p b ON a.id <> b.id)
    SELECT DISTINCT 0::BIGINT AS run_key, least(s, d) AS src, greatest(s, d) AS dst FROM r WHERE r <= 2""")
def edges_knn_sym(spark, folder):
    return G.nearest(X.points(spark, folder), 3)


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT 0::BIGINT AS run_key, a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.01 * 0.01""")
def edges_eps(spark, folder):
    return G.within_distance(X.points(spark, folder), 0.01)


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    ab AS (SELECT a.id AS s, b.id AS d, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS nx, b.x - a.x AS ny, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4 AS r FROM p a JOIN p b ON a.id < b.id),
    c AS (SELECT s, d, 2 * ((c.x - mx) * nx + (c.y - my) * ny) AS side, (c.x - mx) ** 2 + (c.y - my) ** 2 - r AS room FROM ab JOIN p c ON c.id <> s AND c.id <> d),
    t AS (SELECT s, d, max(room / side) FILTER (side < 0) AS low, min(room / side) FILTER (side > 0) AS high FROM c GROUP BY s, d)
    SELECT 0::BIGINT AS run_key, s AS src, d AS dst FROM t WHERE low IS NULL OR high IS NULL OR low <= high""")
def edges_delaunay(spark, folder):
    return G.delaunay(X.points(spark, folder))


@query("""WITH p AS (SELECT count(DISTINCT (embedding[1], embedding[2])) AS n FROM embeddings)
    SELECT 0::BIGINT AS run_key, n AS nodes, true AS connected, true AS planar FROM p""")
def delaunay_invariants(spark, folder):
    p = X.points(spark, folder)
    e = G.delaunay(p)
    parts = G.components(p, e).groupBy("run_key").agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("parts"))
    n = e.groupBy("run_key").agg(F.count("*").alias("edges"))
    return parts.join(n, "run_key").select("run_key", "nodes", (F.col("parts") == 1).alias("connected"), ((F.col("edges") <= 3 * F.col("nodes") - 6) & (F.col("edges") >= 2 * F.col("nodes") - 3)).alias("planar"))


GRID_SQL = """WITH p AS (SELECT p_partkey AS id, p_partkey - (SELECT min(p_partkey) FROM part) AS r, (SELECT floor(sqrt(count(*)))::BIGINT FROM part) AS w FROM part),
    c AS (SELECT id, r % w AS x, r // w AS y FROM p)
    SELECT 0::BIGINT AS run_key, least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM c a JOIN c b ON """


@query(GRID_SQL + "(b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)")
def edges_grid_rook(spark, folder):
    return S.polygon_neighbours(X.cells(spark, folder), "rook")


@query(GRID_SQL + "(b.x = a.x + 1 AND b.y = a.y) OR (b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y = a.y + 1)")
def edges_grid_queen(spark, folder):
    return S.polygon_neighbours(X.cells(spark, folder), "queen")


ZONE_SEGMENTS = """WITH z AS (SELECT row_number() OVER (ORDER BY CODE_IRIS) AS id, geometry[1] AS g FROM zones),
    i AS (SELECT id, g, unnest(range(1, len(g))) AS i FROM z),
    s AS (SELECT id, least(g[i], g[i + 1]) AS lo, greatest(g[i], g[i + 1]) AS hi, g[i] AS p FROM i) """


@query(ZONE_SEGMENTS + "SELECT DISTINCT 0::BIGINT AS run_key, a.id AS src, b.id AS dst FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id < b.id")
def edges_zones_rook(spark, folder):
    return S.polygon_neighbours(X.zones(spark, folder), "rook")


@query(ZONE_SEGMENTS + "SELECT DISTINCT 0::BIGINT AS run_key, a.id AS src, b.id AS dst FROM s a JOIN s b ON a.p = b.p AND a.id < b.id")
def edges_zones_queen(spark, folder):
    return S.polygon_neighbours(X.zones(spark, folder), "queen")


ROADS_SQL = """n AS (SELECT id, min({'x': x, 'y': y}) AS p FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT (x = 0 AND y = 0) GROUP BY id),
    l0 AS (SELECT link_id, min({'f': "from", 't': "to", 'm': length_m}) AS l FROM links GROUP BY link_id),
    l AS (SELECT link_id AS id, a.p AS a, b.p AS b FROM l0 JOIN n a ON a.id = l.f JOIN n b ON b.id = l.t WHERE a.p <> b.p)"""


@query("WITH " + ROADS_SQL + """, e AS (SELECT id, a AS p, b AS q FROM l UNION ALL SELECT id, b, a FROM l),
    m AS (SELECT x.id AS s, y.id AS d, bool_or(abs((x.q.x - x.p.x) * (y.q.y - y.p.y) - (x.q.y - x.p.y) * (y.q.x - y.p.x)) <= 1e-9 * sqrt((x.q.x - x.p.x) ** 2 + (x.q.y - x.p.y) ** 2)
        AND (x.q.x - x.p.x) * (y.q.x - y.p.x) + (x.q.y - x.p.y) * (y.q.y - y.p.y) > 0) AS bad FROM e x JOIN e y ON x.p = y.p AND x.id < y.id GROUP BY 1, 2)
    SELECT 0::BIGINT AS run_key, s AS src, d AS dst FROM m WHERE NOT bad""")
def edges_lines(spark, folder):
    return S.line_neighbours(X.roads(spark, folder))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey - (SELECT min(p_partkey) FROM part) AS r, (SELECT floor(sqrt(count(*)))::BIGINT FROM part) AS w FROM part),
    c AS (SELECT id, r % w AS x, r // w AS y, t.t FROM p CROSS JOIN (VALUES (0), (1), (2)) t(t))
    SELECT 0::BIGINT AS run_key, least(a.id * 3 + a.t, b.id * 3 + b.t) AS src, greatest(a.id * 3 + a.t, b.id * 3 + b.t) AS dst FROM c a JOIN c b
    ON (a.t = b.t AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))) OR (a.id = b.id AND b.t = a.t + 1)""")
def edges_spacetime(spark, folder):
    times = X.grid(spark, folder).select("run_key", "id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t"))
    return G.space_time(S.polygon_neighbours(X.cells(spark, folder), "rook"), times, 3)


@query("""WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    e AS (SELECT a.id AS s, b.id AS d FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.01 * 0.01),
    r(id, o) AS (SELECT id, id FROM p UNION SELECT r.id, e.d FROM r JOIN e ON e.s = r.o)
    SELECT 0::BIGINT AS run_key, id, min(o) AS component FROM r GROUP BY id""")
def components(spark, folder):
    p = X.points(spark, folder)
    return G.components(p, G.within_distance(p, 0.01))


@query("""WITH e AS (SELECT user_id AS k, event_id AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
    SELECT k AS run_key, id, count(*) AS degree FROM (SELECT k, s AS id FROM e WHERE d IS NOT NULL UNION ALL SELECT k, d FROM e WHERE d IS NOT NULL) GROUP BY k, id""")
def degree(spark, folder):
    return G.degrees(G.chain(X.chains(spark, folder), ["ord", "id"]))


@query(ZONE_SEGMENTS + """, e AS (SELECT DISTINCT a.id AS i, b.id AS j FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id <> b.id)
    SELECT 0::BIGINT AS run_key, i, j, -1.0::DOUBLE AS w FROM e UNION ALL SELECT 0, i, i, count(*)::DOUBLE FROM e GROUP BY i""")
def laplacian(spark, folder):
    return G.laplacian(S.polygon_neighbours(X.zones(spark, folder), "rook"))


@query(ZONE_SEGMENTS + """, e AS (SELECT DISTINCT a.id AS i, b.id AS j FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id < b.id),
    c AS (SELECT row_number() OVER (ORDER BY CODE_IRIS) AS id, dense_rank() OVER (ORDER BY INSEE_COM)::INTEGER AS cl FROM zones)
    SELECT 0::BIGINT AS run_key, least(x.cl, y.cl) AS a, greatest(x.cl, y.cl) AS b, count(*) AS w FROM e JOIN c x ON x.id = i JOIN c y ON y.id = j WHERE x.cl <> y.cl GROUP BY 2, 3""")
def quotient_graph(spark, folder):
    z = X.zones(spark, folder)
    labels = z.select("run_key", "id", F.dense_rank().over(Window.orderBy("INSEE_COM")).alias("cl"))
    return G.quotient(S.polygon_neighbours(z, "rook"), labels)[1]


# ---- features and costs ----------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def features_numeric(spark, folder):
    part = table(spark, folder, "part").drop("p_name", "p_brand", "p_type")
    names = P.numeric_columns(part, ("p_partkey",))
    return P.scaled(part, names).select("p_partkey", *names)


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size,
    round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part""")
def features_zscore(spark, folder):
    names = ["p_size", "p_retailprice"]
    return P.scaled(table(spark, folder, "part"), names, "zscore").select("p_partkey", *[F.round(c, 6).alias(c) for c in names])


@query("""SELECT * FROM (SELECT 'nodep' AS feature, count(*) FILTER (nodep IS NULL OR isnan(nodep)) AS n_missing FROM zones UNION ALL SELECT 'marche', count(*) FILTER (marche IS NULL OR isnan(marche)) FROM zones
    UNION ALL SELECT 'velo', count(*) FILTER (velo IS NULL OR isnan(velo)) FROM zones UNION ALL SELECT 'drm', count(*) FILTER (drm IS NULL OR isnan(drm)) FROM zones
    UNION ALL SELECT 'voiture', count(*) FILTER (voiture IS NULL OR isnan(voiture)) FROM zones UNION ALL SELECT 'tcom', count(*) FILTER (tcom IS NULL OR isnan(tcom)) FROM zones)""")
def na_report(spark, folder):
    return P.missing_report(table(spark, folder, "zones"), X.MODES)


PAIRS_SQL = """WITH n AS (SELECT user_id AS k, event_id AS s, value AS a, lead(event_id) OVER w AS d, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT k AS run_key, s AS src, d AS dst, round({}, 6) AS cost FROM n WHERE d IS NOT NULL"""


@query(PAIRS_SQL.format("0.5 * (a - b) ** 2"))
def cost_ward(spark, folder):
    p = X.consecutive(X.chains(spark, folder), ["x"])
    return p.select("run_key", "src", "dst", F.round(V.ward_cost(F.col("a_x"), F.lit(1.0), F.col("b_x"), F.lit(1.0)), 6).alias("cost"))


@query(PAIRS_SQL.format("(a - b) ** 2"))
def cost_sqeuclid(spark, folder):
    p = X.consecutive(X.chains(spark, folder), ["x"])
    return p.select("run_key", "src", "dst", F.round(V.square_distance(F.col("a_x"), F.col("b_x")), 6).alias("cost"))


_COUNT = [f"count(*) FILTER (l_returnflag = '{a}' AND l_linestatus = '{b}')::DOUBLE AS c{i}" for i, (a, b) in enumerate(X.CELLS)]
PROFILE_SQL = f"""WITH c AS (SELECT l_suppkey AS id, {", ".join(_COUNT)} FROM lineitem GROUP BY 1),
    v AS (SELECT id, [c0, c1, c2, c3, c4, c5] AS a FROM c), n AS (SELECT id AS s, a, lead(id) OVER (ORDER BY id) AS d, lead(a) OVER (ORDER BY id) AS b FROM v) """


@query(PROFILE_SQL + f""", t AS (SELECT {", ".join(f"sum(c{i}) AS t{i}" for i in range(6))}, {" + ".join(f"sum(c{i})" for i in range(6))} AS m FROM c)
    SELECT 0::BIGINT AS run_key, s AS src, d AS dst, round({" + ".join(f"coalesce(m / nullif(t{i}, 0), 0) * (a[{i + 1}] / list_sum(a) - b[{i + 1}] / list_sum(b)) ** 2" for i in range(6))}, 6) AS cost FROM n, t WHERE d IS NOT NULL""")
def cost_chisq(spark, folder):
    p = X.profiles(spark, folder)
    pairs = X.consecutive(p, ["counts"])
    return pairs.crossJoin(F.broadcast(_chisq_weights(p))).select("run_key", "src", "dst", F.round(V.chisq_cost(F.col("a_counts"), F.col("b_counts"), F.col("weights")), 6).alias("cost"))


def _chisq_weights(p: DataFrame) -> DataFrame:
    """One row: mass of the table over mass of each column, 0 for empty columns."""
    sums = [F.sum(F.col("counts")[i]) for i in range(len(X.CELLS))]
    mass = sum(sums, F.lit(0.0))
    return p.agg(F.array(*[F.when(s > 0, F.floor(mass) / s).otherwise(0.0) for s in sums]).alias("weights"))


@query(PROFILE_SQL + f"""SELECT i AS cell, round(w, 6) AS weight FROM (SELECT unnest(range(6)) AS i, unnest([{", ".join(f"coalesce(floor((SELECT sum(list_sum(a)) FROM v)) / nullif((SELECT sum(c{i}) FROM c), 0), 0)" for i in range(6))}]) AS w)""")
def chisq_weights(spark, folder):
    return _chisq_weights(X.profiles(spark, folder)).select(F.posexplode("weights").alias("cell", "weight")).select(F.col("cell").cast("bigint").alias("cell"), F.round("weight", 6).alias("weight"))


def _dm_sql(x: str) -> str:
    return f"(lgamma(6.0) + list_sum(list_transform({x}, lambda v: lgamma(v + 1.0))) - 6 * lgamma(1.0) - lgamma(list_sum({x}) + 6.0))"


@query(PROFILE_SQL + f"""SELECT 0::BIGINT AS run_key, s AS src, d AS dst, round({_dm_sql("a")} + {_dm_sql("b")} - {_dm_sql("list_transform(list_zip(a, b), lambda z: z[1] + z[2])")} - lgamma(3.0), 5) AS cost FROM n WHERE d IS NOT NULL""")
def cost_dirichlet_multinomial(spark, folder):
    pairs = X.consecutive(X.profiles(spark, folder), ["counts"])
    return pairs.select("run_key", "src", "dst", F.round(V.multinomial_cost(F.col("a_counts"), F.lit(1.0), F.col("b_counts"), F.lit(1.0)), 5).alias("cost"))


def _ng_sql(x: str, s: str, n: str) -> str:
    k = f"(1.0 + floor({n} / 2))"
    return f"(lgamma({k}) + ln(be) - {k} * ln(be + {s} / 2 + 0.01 * {n} / (2 * (0.01 + {n})) * ({x} - mu) ** 2) + 0.5 * ln(0.01) - 0.5 * ln(0.01 + {n}) - floor({n} / 2) * ln(2 * pi()))"


@query(f"""WITH g AS (SELECT user_id AS id, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) * count(*) AS s FROM events GROUP BY 1),
    q AS (SELECT avg(value) AS mu, 0.1 * var_pop(value) AS be FROM events),
    p AS (SELECT id, n, m, s, lead(id) OVER w AS id2, lead(n) OVER w AS n2, lead(m) OVER w AS m2, lead(s) OVER w AS s2 FROM g WINDOW w AS (ORDER BY id)),
    j AS (SELECT *, n + n2 AS nn, (n * m + n2 * m2) / (n + n2) AS mm FROM p WHERE id2 IS NOT NULL)
    SELECT 0::BIGINT AS run_key, id AS src, id2 AS dst, round({_ng_sql("m", "s", "n")} + {_ng_sql("m2", "s2", "n2")} - {_ng_sql("mm", "(s + s2 + n * (m - mm) ** 2 + n2 * (m2 - mm) ** 2)", "nn")}, 4) AS cost FROM j, q""")
def pair_cost_normal_gamma(spark, folder):
    e = table(spark, folder, "events")
    g = e.groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.array(F.avg("value")).alias("m"), F.array(F.var_pop("value") * F.count("*")).alias("s")).select(X.single(), F.col("user_id").alias("id"), F.col("user_id").alias("ord"), "n", "m", "s")
    q = e.agg(F.array(F.avg("value")).alias("mu"), F.array(0.1 * F.var_pop("value")).alias("be"))
    c = F.col
    return X.consecutive(g, ["n", "m", "s"]).crossJoin(F.broadcast(q)).select("run_key", "src", "dst", F.round(V.gaussian_cost(c("a_m"), c("a_s"), c("a_n"), c("b_m"), c("b_s"), c("b_n"), c("mu"), c("be")), 4).alias("cost"))


@query("""WITH g AS (SELECT user_id AS id, count(*)::DOUBLE AS n, avg(value) AS m FROM events GROUP BY 1), p AS (SELECT id, n, m, lead(id) OVER w AS id2, lead(n) OVER w AS n2, lead(m) OVER w AS m2 FROM g WINDOW w AS (ORDER BY id))
    SELECT 0::BIGINT AS run_key, id AS src, id2 AS dst, round(n * n2 / (n + n2) * (m - m2) ** 2, 5) AS cost FROM p WHERE id2 IS NOT NULL""")
def pair_cost_ward(spark, folder):
    g = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.array(F.avg("value")).alias("m")).select(X.single(), F.col("user_id").alias("id"), F.col("user_id").alias("ord"), "n", "m")
    c = F.col
    return X.consecutive(g, ["n", "m"]).select("run_key", "src", "dst", F.round(V.ward_cost(c("a_m"), c("a_n"), c("b_m"), c("b_n")), 5).alias("cost"))


@query("SELECT round(avg(value), 6) AS mu, round(0.1 * var_pop(value), 6) AS beta, 0.01::DOUBLE AS tau, 1.0::DOUBLE AS kappa FROM events")
def dgmm_prior_defaults(spark, folder):
    return table(spark, folder, "events").agg(F.round(F.avg("value"), 6).alias("mu"), F.round(0.1 * F.var_pop("value"), 6).alias("beta"), F.lit(0.01).alias("tau"), F.lit(1.0).alias("kappa"))


@query("""SELECT s_suppkey, round(lgamma(s_suppkey + 0.5), 5) AS lg, round(ln(exp(s_acctbal / 10000) + exp(-s_acctbal / 5000)), 6) AS la FROM supplier""")
def scalar_functions(spark, folder):
    s = table(spark, folder, "supplier")
    return s.select("s_suppkey", F.round(lgamma_col(F.col("s_suppkey") + 0.5), 5).alias("lg"), F.round(log_add(F.col("s_acctbal") / 10000, -F.col("s_acctbal") / 5000), 6).alias("la"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT user_id, lead(user_id) OVER (ORDER BY user_id) AS nxt FROM (SELECT DISTINCT user_id FROM events))
    SELECT u.user_id, event_type, sum(n)::BIGINT AS n FROM u JOIN c ON c.user_id IN (u.user_id, u.nxt) WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def merged_maps(spark, folder):
    e = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    nxt = e.withColumn("m2", F.lead("m").over(Window.orderBy("user_id"))).where("m2 is not null")
    return nxt.select("user_id", F.explode(V.merge_counts(F.col("m"), F.col("m2"))).alias("event_type", "n"))


# ---- chains ----------------------------------------------------------------------------------------------------------


@query(M.chains("ward", """SELECT c.run_key, c.k::INTEGER AS k, cl, count(*) AS n, round(avg(value), 6) AS mean_value, min(ts) AS first_ts, max(ts) AS last_ts
    FROM cuts c JOIN leaves l ON l.run_key = c.run_key AND l.i = c.i JOIN events ON event_id = l.id GROUP BY ALL""", M.upto(SEGMENTS)))
def ward_chain_profile(spark, folder):
    """Piecewise-constant segmentation of each user's events: the flagship."""
    c = X.chains(spark, folder)
    labels = D.cut(fit_chain(c), k=SEGMENTS)
    return D.rollup(labels, c, {"n": F.count("*"), "mean_value": F.round(F.avg("value"), 6), "first_ts": F.min("ord"), "last_ts": F.max("ord")})


@query("""SELECT user_id AS run_key, round(var_pop(value) * count(*), 3) AS total FROM events GROUP BY 1""")
def ward_chain_total(spark, folder):
    t = fit_chain(X.chains(spark, folder)).levels
    return t.where("k = 1").select("run_key", F.round("level", 3).alias("total"))


@query("SELECT user_id AS run_key, count(*) - 1 AS merges, 0::BIGINT AS falls, 0::BIGINT AS bad FROM events GROUP BY 1 HAVING count(*) > 1")
def merge_integrity(spark, folder):
    """Merges of each run, heights that fall, and merges of nodes that aren't there yet."""
    t = fit_chain(X.chains(spark, folder))
    n = t.leaves.groupBy("run_key").agg(F.count("*").alias("n"))
    m = t.merges.join(n, "run_key").withColumn("before", F.lag("height").over(Window.partitionBy("run_key").orderBy("m")))
    bad = ~((F.col("left") < F.col("right")) & (F.col("right") < F.col("n") - 1 + F.col("m")))
    return m.groupBy("run_key").agg(F.count("*").alias("merges"), F.count_if(F.col("height") < F.col("before") - 1e-9).alias("falls"), F.count_if(bad).alias("bad"))


@query("SELECT DISTINCT user_id AS run_key, 0.0::DOUBLE AS off FROM events")
def ward_cluster_means(spark, folder):
    """The prototypes that the tree holds against the means of their members."""
    c = X.chains(spark, folder)
    t = fit_chain(c)
    means = D.profiles(t, D.cut(t, k=1)).select("run_key", F.col("mean")[0].alias("mean"))
    root = t.merges.groupBy("run_key").agg(F.max_by(F.col("center")[0], "m").alias("center"))
    return root.join(means, "run_key").select("run_key", F.round(F.abs(F.col("center") - F.col("mean")), 6).alias("off"))


LABELS = "SELECT c.run_key, asked::DOUBLE AS cut, c.k::INTEGER AS k, id, cl FROM cuts c JOIN leaves USING (run_key, i)"


@query(M.chains("ward", LABELS, M.upto(3, 5, 8)))
def cut_k(spark, folder):
    return D.cut(fit_chain(X.chains(spark, folder)), k=[3, 5, 8])


@query(M.chains("ward", LABELS, "SELECT run_key, t.h AS asked, 1 + count(*) FILTER (height > t.h) AS k FROM heights, (VALUES (10.0), (1000.0)) t(h) GROUP BY run_key, t.h"))
def cut_h(spark, folder):
    return D.cut(fit_chain(X.chains(spark, folder)), h=[10.0, 1000.0])


@query("SELECT user_id AS run_key, 1::BIGINT AS split, 0::BIGINT AS moved FROM events GROUP BY 1")
def cut_nested(spark, folder):
    """From five to four clusters, two become one and the others stay."""
    labels = D.cut(fit_chain(X.chains(spark, folder)), k=[4, 5])
    a, b = (labels.where(F.col("k") == k).select("run_key", "id", F.col("cl").alias(f"c{k}")) for k in (4, 5))
    pairs = a.join(b, ["run_key", "id"]).groupBy("run_key", "c4", "c5").count()
    up = pairs.groupBy("run_key", "c4").agg(F.count("*").alias("n")).groupBy("run_key").agg(F.count_if(F.col("n") == 2).alias("split"))
    down = pairs.groupBy("run_key", "c5").agg(F.count("*").alias("n")).groupBy("run_key").agg(F.count_if(F.col("n") > 1).alias("moved"))
    return up.join(down, "run_key")


@query(M.chains("ward", """SELECT run_key, k::INTEGER AS k, id, ord FROM (SELECT c.run_key, c.k, id, ts AS ord, cl, lag(cl) OVER (PARTITION BY c.run_key ORDER BY c.i) AS before
    FROM cuts c JOIN leaves USING (run_key, i) JOIN events ON event_id = id) WHERE cl <> before""", M.upto(SEGMENTS)))
def change_points(spark, folder):
    c = X.chains(spark, folder)
    return W.change_points(D.cut(fit_chain(c), k=SEGMENTS), c.select("run_key", "id", "ord"))


@query(M.chains("ward", "SELECT run_key, k::INTEGER AS k, round(level / nn, 5) AS within FROM levels WHERE k = 5"))
def explained_variance(spark, folder):
    """The variance within five segments from their members, against what the levels of the tree leave."""
    c = X.chains(spark, folder)
    return W.explained_variance(D.cut(fit_chain(c), k=SEGMENTS), c, "value").select("run_key", "k", F.round("within", 5).alias("within"))


@query(M.chains("ward", """SELECT run_key, k::INTEGER AS k, round(sum(ss) / sum(n), 6) AS within, round(1 - sum(ss) / any_value(whole), 6) AS share FROM
    (SELECT c.run_key, c.k, cl, count(*) AS n, var_pop(value) * count(*) AS ss FROM cuts c JOIN leaves USING (run_key, i) JOIN events ON event_id = id GROUP BY 1, 2, 3)
    JOIN (SELECT user_id AS run_key, var_pop(value) * count(*) AS whole FROM events GROUP BY 1) USING (run_key) GROUP BY run_key, k""", M.upto(2, 5, 10)))
def explained_variance_by_k(spark, folder):
    c = X.chains(spark, folder)
    return W.explained_variance(D.cut(fit_chain(c), k=[2, 5, 10]), c, "value").select("run_key", "k", F.round("within", 6).alias("within"), F.round("share", 6).alias("share"))


def nmi(spark, folder):
    p = X.points(spark, folder)
    t = fit_graph(p.select("run_key", "id", F.col("features").alias("x")), G.nearest(p, 12))
    return W.mutual_information(D.cut(t, k=[5, 10]), p.select("run_key", "id", F.col("label").alias("truth"))).select("run_key", "k", F.round("nmi", 6).alias("nmi"))


PLACED = "placed AS (SELECT run_key, unnest(o) AS i, (unnest(range(len(o))))::INTEGER AS place FROM merges WHERE m = nn - 1 AND m > 0)"


@query(M.chains("ward", ", " + PLACED + " SELECT run_key, id, place FROM placed JOIN leaves USING (run_key, i)"))
def leaf_order(spark, folder):
    return fit_chain(X.chains(spark, folder)).leaves.select("run_key", "id", "place")


#: Branches of the ten last: nodes below the last nine merges, numbered by merge, left sides first.
BRANCHES = """, late AS (SELECT run_key, nn, m, l, r, least(nn, 10) AS keep FROM merges WHERE m > nn - least(nn, 10) AND m > 0),
    hung AS (SELECT run_key, node, row_number() OVER (PARTITION BY run_key ORDER BY side, m) AS branch FROM (SELECT run_key, m, 0 AS side, l AS node, nn, keep FROM late UNION ALL SELECT run_key, m, 1, r, nn, keep FROM late) WHERE node < nn + nn - keep) """


@query(M.chains("ward", BRANCHES + "SELECT c.run_key, branch::INTEGER AS branch, id FROM flat c JOIN leaves USING (run_key, i) JOIN hung h ON h.run_key = c.run_key AND h.node = c.node", M.upto(10)))
def collapse(spark, folder):
    return D.collapse(fit_chain(X.chains(spark, folder)), 10)[1]


@query(M.chains("ward", BRANCHES + """SELECT t.run_key, (t.m - nn + keep)::INTEGER AS m, coalesce(-a.branch, t.l - 2 * nn + keep + 1)::INTEGER AS a, coalesce(-b.branch, t.r - 2 * nn + keep + 1)::INTEGER AS b, round(height + 3.3e-7, 5) AS height
    FROM late t LEFT JOIN hung a ON a.run_key = t.run_key AND a.node = t.l LEFT JOIN hung b ON b.run_key = t.run_key AND b.node = t.r JOIN heights h ON h.run_key = t.run_key AND h.m = t.m"""))
def collapse_merges(spark, folder):
    return D.collapse(fit_chain(X.chains(spark, folder)), 10)[0].withColumn("height", steady("height"))


@query(M.chains("ward", "SELECT run_key, m::INTEGER AS m, CASE WHEN l < nn THEN -l - 1 ELSE l - nn + 1 END::INTEGER AS a, CASE WHEN r < nn THEN -r - 1 ELSE r - nn + 1 END::INTEGER AS b, round(height + 3.3e-7, 5) AS height FROM merges JOIN heights USING (run_key, m) WHERE m > 0"))
def signed_merges(spark, folder):
    return D.signed_merges(fit_chain(X.chains(spark, folder))).select("run_key", "m", "a", "b", steady("height"))


@query(M.chains("bayes_dgmm", """, steps AS (SELECT l.run_key, l.k, -level AS gain, coalesce(h.slope, 0.0) AS xend FROM levels l JOIN tops USING (run_key) LEFT JOIN hull h ON h.run_key = l.run_key AND h.k = l.k WHERE l.k <= top),
    firsts AS (SELECT run_key, min(k) AS k, arg_min(gain, k) AS gain, xend FROM steps GROUP BY run_key, xend),
    spans AS (SELECT *, coalesce(lag(xend) OVER (PARTITION BY run_key ORDER BY k), max(xend) OVER (PARTITION BY run_key) * 1.05) AS x FROM firsts)
    SELECT run_key, k::INTEGER AS k, round(gain, 5) AS gain, round(x, 5) AS x, round(xend, 5) AS xend, round(coalesce((x - xend) / nullif(first(x) OVER (PARTITION BY run_key ORDER BY k), 0), 1), 5) AS share FROM spans"""))
def front(spark, folder):
    return D.front(fit_chain(X.chains(spark, folder), "bayes_dgmm")).select("run_key", "k", *[F.round(c, 5).alias(c) for c in ("gain", "x", "xend", "share")])


@query(M.chains("ward", ", " + PLACED + """, drawn AS (
        SELECT run_key, 0::BIGINT AS m, 0::BIGINT AS l, 0::BIGINT AS r, count(*) AS nn, list((place + 1)::DOUBLE ORDER BY i) AS xs, [0.0::DOUBLE] AS ys FROM placed GROUP BY run_key
        UNION ALL SELECT d.run_key, g.m, g.l, g.r, d.nn, list_append(xs, (xs[g.l + 1] + xs[g.r + 1]) / 2), list_append(ys, h.height) FROM drawn d JOIN merges g ON g.run_key = d.run_key AND g.m = d.m + 1 JOIN heights h ON h.run_key = d.run_key AND h.m = g.m),
    lines AS (SELECT run_key, m, ys[m + 1] AS t, xs[l + 1] AS xa, xs[r + 1] AS xb, CASE WHEN l < nn THEN 0.0 ELSE ys[l - nn + 2] END AS ya, CASE WHEN r < nn THEN 0.0 ELSE ys[r - nn + 2] END AS yb FROM drawn WHERE m > 0)
    SELECT run_key, m::INTEGER AS m, x, round(y + 3.3e-7, 5) AS y, xend, round(yend + 3.3e-7, 5) AS yend FROM (SELECT run_key, m, xa AS x, t AS y, xb AS xend, t AS yend FROM lines UNION ALL SELECT run_key, m, xa, ya, xa, t FROM lines UNION ALL SELECT run_key, m, xb, yb, xb, t FROM lines)"""))
def dendro_segments(spark, folder):
    return D.segments(fit_chain(X.chains(spark, folder))).withColumns({c: steady(c) for c in ("y", "yend")})


@query("SELECT user_id AS run_key, count(*) AS n, least(count(*), 12)::BIGINT AS branches FROM events GROUP BY 1")
def plot_branches(spark, folder):
    return D.drawing(fit_chain(X.chains(spark, folder)), 12)[1].groupBy("run_key").agg(F.sum("size").alias("n"), F.count("*").alias("branches"))


PROFILE_LEAVES = f"SELECT 0::BIGINT AS run_key, id, row_number() OVER (ORDER BY id) - 1 AS i, [c0, c1, c2, c3, c4, c5] AS x FROM (SELECT l_suppkey AS id, {', '.join(_COUNT)} FROM lineitem GROUP BY 1)"


def _profile_tree(method: str, rest: str, ks: str | None = None) -> str:
    return f"WITH RECURSIVE {M.tree(method, PROFILE_LEAVES)}, {M.HEIGHTS}{', ' + M.cuts(ks) if ks else ''} {rest}"


def _chain_method(name: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # compositions and counts have to be more than one number
        p = X.profiles(spark, folder)
        x = "shares" if name == "bayes_dirichlet" else "counts"
        t = fit_chain(p.select("run_key", "id", "ord", F.col(x).alias("x")), name)
        return t.merges.select("run_key", "m", "left", "right", steady("cost"), steady("height"), "size")

    run.__name__ = f"chain_{name}"
    sql = _profile_tree(name, 'SELECT run_key, m::INTEGER AS m, l::INTEGER AS "left", r::INTEGER AS "right", round(cost + 3.3e-7, 5) AS cost, round(height + 3.3e-7, 5) AS height, size FROM merges JOIN heights USING (run_key, m) WHERE m > 0') if name in M.RULES else None
    query(sql)(run)


for _name in ("ward", "centroid", "median", "chisq", "bayes_mom", "bayes_dirichlet"):
    _chain_method(_name)


@query(M.chains("bayes_dgmm", 'SELECT run_key, m::INTEGER AS m, l::INTEGER AS "left", r::INTEGER AS "right", round(cost + 3.3e-7, 5) AS cost, round(height + 3.3e-7, 5) AS height, size FROM merges JOIN heights USING (run_key, m) WHERE m > 0'))
def chain_bayes_dgmm(spark, folder):
    # the prior of each user's run comes from its own events
    t = fit_chain(X.chains(spark, folder), "bayes_dgmm")
    return t.merges.select("run_key", "m", "left", "right", steady("cost"), steady("height"), "size")


SIZES = "SELECT run_key, k::INTEGER AS k, cl, count(*) AS n FROM cuts GROUP BY ALL"


@query(M.chains("bayes_dgmm", SIZES, M.BEST))
def bayes_dgmm_segments(spark, folder):
    c = X.chains(spark, folder)
    return D.cut_best(fit_chain(c, "bayes_dgmm")).groupBy("run_key", "k", "cl").agg(F.count("*").alias("n"))


@query(_profile_tree("bayes_mom", SIZES, M.BEST))
def bayes_mom_segments(spark, folder):
    p = X.profiles(spark, folder)
    return D.cut_best(fit_chain(p.select("run_key", "id", "ord", F.col("counts").alias("x")), "bayes_mom")).groupBy("run_key", "k", "cl").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS run_key, k, round(lgamma(n + 1.0) - (lgamma(n::DOUBLE) - lgamma(k::DOUBLE) - lgamma(n - k + 1.0)) - lgamma(k + 1.0), 5) AS prior_k
    FROM (SELECT user_id, count(*) AS n, unnest(range(1, count(*) + 1)) AS k FROM events GROUP BY 1)""")
def prior_k(spark, folder):
    n = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return n.select(F.col("user_id").alias("run_key"), "k", F.round(V.prior_k(F.col("n").cast("double"), F.col("k").cast("double")), 5).alias("prior_k"))


# ---- spanning trees and general graphs -------------------------------------------------------------------------------


@query("""SELECT * FROM (SELECT 'path' AS family, n::BIGINT AS n, 0.0::DOUBLE AS ln_trees FROM range(3, 41) t(n) UNION ALL SELECT 'cycle', n, round(ln(n), 6) FROM range(3, 41) t(n)
    UNION ALL SELECT 'complete', n, round((n - 2) * ln(n), 6) FROM range(3, 41) t(n))""")
def log_sptree_families(spark, folder):
    n = spark.range(3, 41).withColumnRenamed("id", "n").withColumn("family", F.explode(F.array(F.lit("path"), F.lit("cycle"), F.lit("complete"))))
    nodes = n.withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    pairs = nodes.withColumnRenamed("id", "src").withColumn("dst", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).where("src < dst")
    near = (F.col("dst") == F.col("src") + 1) | ((F.col("family") == "cycle") & (F.col("src") == 0) & (F.col("dst") == F.col("n") - 1))
    edges = pairs.where((F.col("family") == "complete") | near)
    return T.log_spanning_trees(nodes, edges, ["family", "n"]).select("family", "n", (F.round("ln_trees", 6) + 0.0).alias("ln_trees"))


SEVEN = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (6, 7)]


@query("SELECT 7::BIGINT AS n, round(ln(9), 6) AS whole, true AS same")
def sptree_prior(spark, folder):
    """Priors that the fit keeps up, against those computed anew from the graph, on a graph of seven nodes with nine trees."""
    edges = spark.createDataFrame([(0, a, b) for a, b in SEVEN], "run_key bigint, src bigint, dst bigint")
    nodes = spark.range(1, 8).select(X.single(), "id", F.array((F.col("id") * 37 % 11).cast("double"), (F.col("id") * 53 % 7).cast("double")).alias("x"))
    t = fit_graph(nodes, edges, "bayes_dgmm")
    both = T.tree_prior(t, edges, 7).join(t.levels.select("run_key", "k", "prior_intra", "prior_inter"), ["run_key", "k"])
    return both.groupBy("run_key").agg(F.count("*").alias("n"), F.round(F.max(F.when(F.col("k") == 1, F.col("intra"))), 6).alias("whole"), F.bool_and(F.abs(F.col("intra") - F.col("prior_intra")) < 1e-9).alias("same")).drop("run_key")


@query()
def sptree_prior_zones(spark, folder):
    z = X.zones(spark, folder)
    edges = S.polygon_neighbours(z, "rook")
    t = fit_graph(_zone_counts(z), edges, "bayes_mom")
    return T.tree_prior(t, edges, 20).select("run_key", "k", *[F.round(c, 6).alias(c) for c in ("inter", "intra", "cnk", "ptot")])


def _zone_counts(z: DataFrame) -> DataFrame:
    """Counts of zones by mode, missing ones as 0."""
    return z.select("run_key", "id", F.array(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in X.MODES]).alias("x"))


@query("SELECT 0::BIGINT AS run_key, 0.0::DOUBLE AS off")
def ward_grid_total(spark, folder):
    """Ward over the grid: the last level against the squares about the mean."""
    g = X.grid(spark, folder)
    t = fit_graph(g, S.polygon_neighbours(X.cells(spark, folder, ranked=True), "rook"))
    whole = g.agg(sum((F.var_pop(F.col("x")[i]) * F.count("*") for i in (0, 1)), F.lit(0.0)).alias("ss"))
    return t.levels.where("k = 1").crossJoin(F.broadcast(whole)).select("run_key", F.round(F.abs(F.col("level") / F.col("ss") - 1), 6).alias("off"))


_MODES = ", ".join(f"CASE WHEN isnan({c}) THEN 0 ELSE coalesce({c}, 0) END::DOUBLE" for c in X.MODES)
ZONE_LEAVES = f"SELECT 0::BIGINT AS run_key, row_number() OVER (ORDER BY CODE_IRIS) AS id, row_number() OVER (ORDER BY CODE_IRIS) - 1 AS i, [{_MODES}] AS x FROM zones"
ZONE_EDGES = {"rook": "SELECT DISTINCT 0::BIGINT AS run_key, a.id - 1 AS u, b.id - 1 AS v FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id < b.id", "queen": "SELECT DISTINCT 0::BIGINT AS run_key, a.id - 1 AS u, b.id - 1 AS v FROM s a JOIN s b ON a.p = b.p AND a.id < b.id"}


def _zone_tree(method: str, adjacency: str, rest: str, k: int = 9) -> str:
    return f"{ZONE_SEGMENTS.replace('WITH', 'WITH RECURSIVE', 1)}, {M.tree(method, ZONE_LEAVES, ZONE_EDGES[adjacency])}, {M.cuts(M.upto(k))} {rest}"


def _zone_method(name: str, adjacency: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        z = X.zones(spark, folder)
        t = fit_graph(_zone_counts(z), S.polygon_neighbours(z, adjacency), name)
        return D.cut(t, k=9).groupBy("cl").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))

    run.__name__ = f"zones_{name}_{adjacency}"
    # orders that depend on numbers of spanning trees have no SQL
    query(None if name.startswith("bayes") else _zone_tree(name, adjacency, "SELECT cl, count(*) AS n, min(i) + 1 AS first_id FROM cuts GROUP BY cl"))(run)


for _name, _how in (("ward", "rook"), ("ward", "queen"), ("chisq", "queen"), ("bayes_mom", "rook"), ("bayes_dgmm", "queen")):
    _zone_method(_name, _how)


@query("SELECT 9::BIGINT AS clusters, count(*) AS n, true AS connected FROM zones")
def clusters_connected(spark, folder):
    """Each of nine clusters is one component of the contiguity graph within it."""
    z = X.zones(spark, folder)
    edges = S.polygon_neighbours(z, "rook")
    labels = D.cut(fit_graph(_zone_counts(z), edges), k=9)
    inside, _ = G.quotient(edges, labels)
    parts = G.components(labels.select(F.col("cl").cast("bigint").alias("run_key"), "id"), inside.select(F.col("cl").cast("bigint").alias("run_key"), "src", "dst"))
    return parts.groupBy("run_key").agg(F.count("*").alias("n"), F.count_distinct("component").alias("parts")).agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.bool_and(F.col("parts") == 1).alias("connected"))


@query("SELECT 0.0::DOUBLE AS off, count(*) AS n FROM zones")
def dissolve_polygons(spark, folder):
    """The area of nine dissolved clusters against that of their zones, and the zones in them."""
    z = X.zones(spark, folder)
    labels = D.cut(fit_graph(_zone_counts(z), S.polygon_neighbours(z, "rook")), k=9)
    area = lambda g: F.abs(F.aggregate(g, F.lit(0.0), lambda acc, r: acc + S.ring_area(r)))
    whole = z.agg(F.sum(area(F.col("geometry"))).alias("whole"))
    got = S.dissolve_polygons(z, labels).agg(F.sum(area(F.col("geometry"))).alias("got"), F.sum("n").alias("n"))
    return got.crossJoin(F.broadcast(whole)).select(F.round(F.abs(F.col("got") / F.col("whole") - 1), 6).alias("off"), "n")


def _zone_approx(name: str, adjacency: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        z = X.zones(spark, folder)
        t = fit_graph(_zone_counts(z), S.polygon_neighbours(z, adjacency), Method(name, approx=True))
        return t.merges.select("run_key", "m", "left", "right", F.round("cost", 4).alias("cost"), "size")

    run.__name__ = f"zones_{name}_{adjacency}_approx"
    query(_zone_tree(name, adjacency, 'SELECT run_key, m::INTEGER AS m, l::INTEGER AS "left", r::INTEGER AS "right", round(cost, 4) AS cost, size FROM merges WHERE m > 0'))(run)


for _name, _how in (("bayes_mom", "rook"), ("bayes_dgmm", "queen")):
    _zone_approx(_name, _how)


_AREA = "abs(list_sum(list_transform(range(1, len(g)), lambda j: g[j].x * g[j + 1].y - g[j + 1].x * g[j].y))) / 2"


@query(_zone_tree("ward", "rook", f"""SELECT cl, count(*) AS n, {", ".join(f"round(avg(x[{i + 1}]), 5) AS {c}" for i, c in enumerate(X.MODES))}, round(sum({_AREA}) / 1e6, 4) AS area
    FROM cuts c JOIN leaves USING (run_key, i) JOIN z ON z.id = leaves.id GROUP BY cl"""))
def geocut_zones(spark, folder):
    """Clusters with size, prototype and the area of their geometry."""
    z = X.zones(spark, folder)
    t = fit_graph(_zone_counts(z), S.polygon_neighbours(z, "rook"))
    labels = D.cut(t, k=9)
    both = S.dissolve_polygons(z, labels).join(D.profiles(t, labels).select("run_key", "cl", "mean"), ["run_key", "cl"])
    area = F.abs(F.aggregate("geometry", F.lit(0.0), lambda acc, r: acc + S.ring_area(r)))
    return both.select("cl", "n", *[F.round(F.col("mean")[i], 5).alias(c) for i, c in enumerate(X.MODES)], F.round(area / 1e6, 4).alias("area"))


POINT_LEAVES = "SELECT 0::BIGINT AS run_key, vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding[3:64], lambda v: v::DOUBLE) AS x, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings"
KNN_EDGES = """SELECT DISTINCT 0::BIGINT AS run_key, least(s, d) AS u, greatest(s, d) AS v FROM (SELECT a.i AS s, b.i AS d, row_number() OVER (PARTITION BY a.i ORDER BY (a.px - b.px) ** 2 + (a.py - b.py) ** 2, b.id) AS r FROM leaves a JOIN leaves b ON a.i <> b.i) WHERE r <= 11"""


query(f"""WITH RECURSIVE {M.tree('ward', POINT_LEAVES, KNN_EDGES)}, {M.cuts(M.upto(5, 10))},
    c AS (SELECT k, cl, label, count(*)::DOUBLE AS n FROM cuts JOIN leaves USING (run_key, i) JOIN embeddings ON vec_id = id GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS whole, sum(n) OVER (PARTITION BY k, cl) AS a, sum(n) OVER (PARTITION BY k, label) AS b FROM c)
    SELECT 0::BIGINT AS run_key, k::INTEGER AS k, round(sum(n / whole * ln(n * whole / (a * b))) / greatest(-sum(n / whole * ln(a / whole)), -sum(n / whole * ln(b / whole))), 6) AS nmi FROM t GROUP BY k""")(nmi)


@query(f"WITH RECURSIVE {M.tree('ward', POINT_LEAVES, KNN_EDGES)}, {M.cuts(M.upto(9))} SELECT cl, count(*) AS n, count(*)::INTEGER AS points FROM cuts GROUP BY cl")
def geocut_points(spark, folder):
    p = X.points(spark, folder)
    t = fit_graph(p.select("run_key", "id", F.col("features").alias("x")), G.nearest(p, 12))
    return S.dissolve_parts(p.select("run_key", "id", F.struct("x", "y").alias("geometry")), D.cut(t, k=9)).select("cl", "n", F.size("geometry").alias("points"))


# ---- flows -----------------------------------------------------------------------------------------------------------

ODS_SQL = """z AS (SELECT row_number() OVER (ORDER BY CODE_IRIS) AS id, trim(regroupement_desc) AS c FROM zones),
    f AS (SELECT o.id AS o, d.id AS d, sum(Volume) AS vol FROM ods JOIN z o ON trim(Origine) = o.c JOIN z d ON trim(Destination) = d.c WHERE Volume > 0 AND NOT isnan(Volume) GROUP BY 1, 2)"""


def _flows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    z = X.zones(spark, folder)
    return z, O.triplets(table(spark, folder, "ods"), z, origin="Origine", destination="Destination", volume="Volume", zone="regroupement_desc")


@query(f"WITH {ODS_SQL} SELECT 0::BIGINT AS run_key, o, d, round(vol, 6) AS vol FROM f")
def od_triplets(spark, folder):
    return _flows(spark, folder)[1].withColumn("vol", F.round("vol", 6))


@query(f"""WITH {ODS_SQL} SELECT 0::BIGINT AS run_key, id, round(sum(a), 5) AS out_vol, round(sum(b), 5) AS in_vol, round(sum(c), 5) AS inside FROM
    (SELECT o AS id, vol AS a, 0.0::DOUBLE AS b, CASE WHEN o = d THEN vol ELSE 0 END AS c FROM f UNION ALL SELECT d, 0, vol, 0 FROM f) GROUP BY id""")
def od_degrees(spark, folder):
    return O.degrees(_flows(spark, folder)[1]).select("run_key", "id", *[F.round(c, 5).alias(c) for c in ("out_vol", "in_vol", "inside")])


@query(f"WITH {ODS_SQL} SELECT 0::BIGINT AS run_key, round((SELECT sum(vol) FROM f WHERE o <> d), 4) AS links, (SELECT count(*) * (count(*) - 1) FROM z) AS pairs")
def od_external(spark, folder):
    z, f = _flows(spark, folder)
    return O.external(f, z).withColumn("links", F.round("links", 4))


@query()
def sbm_regions(spark, folder):
    z, f = _flows(spark, folder)
    t = fit_flows(z.select("run_key", "id"), S.polygon_neighbours(z, "rook"), f)
    return D.cut_best(t).groupBy("k", "cl").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# ---- steps around a fit ----------------------------------------------------------------------------------------------


@query("""SELECT link_id, day, 0 AS hour, 5 AS minute, CASE WHEN NOT isnan(v) THEN v END AS value FROM (SELECT link_id, 7 AS day, D7 AS v FROM v_pick UNION ALL SELECT link_id, 8, D8 FROM v_pick UNION ALL SELECT link_id, 9, D9 FROM v_pick)""")
def wide_to_long(spark, folder):
    wide = table(spark, folder, "v_pick").withColumnsRenamed({d: f"{d}T0H5" for d in ("D7", "D8", "D9")})
    return W.wide_to_long(wide, "link_id")


@query("""SELECT link_id, ceil(epoch_us(ts) / 900000000.0)::BIGINT * 900 AS slot_end, count(*) AS n, round(avg(speed), 6) AS mean FROM speeds_long
    WHERE link_id IS NOT NULL AND speed IS NOT NULL AND NOT isnan(speed) GROUP BY 1, 2""")
def quarter_hour_means(spark, folder):
    s = table(spark, folder, "speeds_long").where("link_id is not null and speed is not null and not isnan(speed)")
    return s.groupBy("link_id", W.ceiling_window(F.col("ts"), 900).alias("slot_end")).agg(F.count("*").alias("n"), F.round(F.avg("speed"), 6).alias("mean"))


@query("""SELECT CODE_IRIS, round(ln(velo + 1) - ln(voiture + 1), 6) AS alr_velo, round(100 * velo / nullif(velo + voiture, 0), 6) AS pct_velo FROM zones""")
def mode_ratios(spark, folder):
    z = table(spark, folder, "zones")
    return z.select("CODE_IRIS", *W.log_ratio(["velo"], "voiture"), W.row_shares(["velo", "voiture"])[0]).select("CODE_IRIS", F.round("alr_velo", 6).alias("alr_velo"), F.round("pct_velo", 6).alias("pct_velo"))


@query(ZONE_SEGMENTS + """, e AS (SELECT DISTINCT a.id AS i, b.id AS j FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id <> b.id),
    v AS (SELECT row_number() OVER (ORDER BY CODE_IRIS) AS id, coalesce(velo, 0) AS velo FROM zones)
    SELECT v.id, CASE WHEN v.velo < 10 THEN v.velo + coalesce(sum(w.velo), 0) ELSE v.velo END AS velo FROM v LEFT JOIN e ON e.i = v.id LEFT JOIN v w ON w.id = e.j GROUP BY v.id, v.velo""")
def smoothed_counts(spark, folder):
    z = X.zones(spark, folder)
    v = z.select("run_key", "id", F.coalesce("velo", F.lit(0.0)).alias("velo"))
    out = W.smooth_small(v.withColumn("total", F.col("velo")), S.polygon_neighbours(z, "rook"), ["velo"], "total", 10.0)
    return out.select("id", "velo")


@query(ZONE_SEGMENTS + """, e AS (SELECT DISTINCT a.id AS i, b.id AS j FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id <> b.id),
    v AS (SELECT row_number() OVER (ORDER BY CODE_IRIS) AS id, velo FROM zones)
    SELECT v.id, round(coalesce(v.velo, avg(w.velo), (SELECT avg(velo) FROM v)), 6) AS velo FROM v LEFT JOIN e ON e.i = v.id LEFT JOIN v w ON w.id = e.j GROUP BY v.id, v.velo""")
def neighbour_fill(spark, folder):
    z = X.zones(spark, folder)
    return W.fill_from_neighbours(z.select("run_key", "id", "velo"), S.polygon_neighbours(z, "rook"), "velo").select("id", F.round("velo", 6).alias("velo"))


@query(M.chains("ward", """SELECT run_key, cl, from_cl, w AS overlap FROM (SELECT a.run_key, a.cl, b.cl AS from_cl, count(*)::DOUBLE AS w FROM cuts a JOIN cuts b USING (run_key, i) WHERE a.asked = 8 AND b.asked = 5 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY run_key, cl ORDER BY w DESC, from_cl) = 1""", M.upto(5, 8)))
def tracked_clusters(spark, folder):
    """Five segments of each chain by value, tracked to its eight segments."""
    c = X.chains(spark, folder)
    labels = D.cut(fit_chain(c), k=[5, 8])
    a, b = (labels.where(F.col("k") == k).select("run_key", "id", "cl") for k in (5, 8))
    return W.track(a, b, c.select("run_key", "id", F.lit(1.0).alias("w")))
