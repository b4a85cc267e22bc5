"""Queries of flows' costs, regression, files, tests of significance and streams, with SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contigua.functions.dirichlet import evidence_col
from contigua.functions.glm import fit_groups
from contigua.operators import geometry as S
from contigua.operators import graph as G
from contigua.operators import prep as P
from contigua.operators import sptree as T
from contigua.operators import workload as W
from contigua.operators.fit import fit_graph, flow_costs
from contigua.plans import fixtures as X
from contigua.plans import tree_sql as M
from contigua.plans.cluster_queries import ODS_SQL, QUERIES, SQL, ZONE_EDGES, ZONE_LEAVES, ZONE_SEGMENTS, _flows, _zone_counts, query
from contigua.plans.shared import shared_folder
from contigua.sources.tables import read_csv, table, with_attributes, write
from contigua.streaming.segments import tumbling
from contigua.types import Method, method_of

__all__ = ["QUERIES", "SQL"]  # with those of cluster_queries, to which these are added

# ---- flows -----------------------------------------------------------------------------------------------------------

_DEG = "(lgamma({n}) + {k} * ln({n}) - lgamma({n} + {k}))"
_VOL = "(lgamma({e} + 1.0) + {e} * ln({lam}) - ({e} + 1.0) * ln({lam} * {p} + 1.0))"


def _deg(n: str, *ks: str) -> str:
    return " + ".join(_DEG.format(n=n, k=k) for k in ks)


def _vol(e: str, lam: str, p: str) -> str:
    return _VOL.format(e=e, lam=lam, p=p)


_FLOW_CTE = f"""{ZONE_SEGMENTS}, {ODS_SQL.replace("z AS", "zz AS", 1).replace("JOIN z o", "JOIN zz o").replace("JOIN z d", "JOIN zz d")},
    c AS (SELECT (SELECT count(*) FROM zz)::DOUBLE AS nn, sum(vol) / (SELECT count(*) FROM zz) ** 2 * 100 AS li, sum(vol) / (SELECT count(*) FROM zz) ** 2 / 100 AS lo, sum(vol) FILTER (o <> d) AS links FROM f),
    k AS (SELECT zz.id, coalesce((SELECT sum(vol) FROM f WHERE o = zz.id), 0) AS ko, coalesce((SELECT sum(vol) FROM f WHERE d = zz.id), 0) AS ki, coalesce((SELECT sum(vol) FROM f WHERE o = zz.id AND d = zz.id), 0) AS ins FROM zz),
    e AS (SELECT DISTINCT a.id AS g, b.id AS h FROM s a JOIN s b ON a.lo = b.lo AND a.hi = b.hi AND a.id < b.id),
    j AS (SELECT e.g, e.h, a.ko AS ago, a.ki AS agi, a.ins AS gin, b.ko AS bgo, b.ki AS bgi, b.ins AS hin, coalesce(x.vol, 0) AS gh, coalesce(y.vol, 0) AS hg FROM e JOIN k a ON a.id = e.g JOIN k b ON b.id = e.h LEFT JOIN f x ON x.o = e.g AND x.d = e.h LEFT JOIN f y ON y.o = e.h AND y.d = e.g),
    own AS (SELECT j.*, c.*, {_deg("1.0", "ago", "agi", "bgo", "bgi")} - ({_deg("2.0", "(ago + bgo)", "(agi + bgi)")})
        + {_vol("gin", "li", "1.0")} + {_vol("hin", "li", "1.0")} - {_vol("(gin + hin + gh + hg)", "li", "4.0")} AS base FROM j, c)"""


@query(f"""{_FLOW_CTE} SELECT 0::BIGINT AS run_key, g AS src, h AS dst, round(base + {_vol("links", "lo", "(nn * (nn - 1))")} - {_vol("(links - gh - hg)", "lo", "(nn * (nn - 1) - 2)")}, 4) AS cost FROM own""")
def flow_cost_planted(spark, folder):
    z, f = _flows(spark, folder)
    return flow_costs(z.select("run_key", "id"), S.polygon_neighbours(z, "rook"), f).withColumn("cost", F.round("cost", 4))


@query(f"""{_FLOW_CTE},
    w AS (SELECT g, h, zz.id AS o, coalesce(a.vol, 0) AS go, coalesce(b.vol, 0) AS ho, coalesce(x.vol, 0) AS gi, coalesce(y.vol, 0) AS hi FROM e JOIN zz ON zz.id <> g AND zz.id <> h
        LEFT JOIN f a ON a.o = g AND a.d = zz.id LEFT JOIN f b ON b.o = h AND b.d = zz.id LEFT JOIN f x ON x.d = g AND x.o = zz.id LEFT JOIN f y ON y.d = h AND y.o = zz.id),
    t AS (SELECT g, h, sum({_vol("go", "lo", "1.0")} + {_vol("ho", "lo", "1.0")} + {_vol("gi", "lo", "1.0")} + {_vol("hi", "lo", "1.0")} - {_vol("(go + ho)", "lo", "2.0")} - {_vol("(gi + hi)", "lo", "2.0")}) AS others FROM w, c GROUP BY g, h)
    SELECT 0::BIGINT AS run_key, g AS src, h AS dst, round(base + others + {_vol("gh", "lo", "1.0")} + {_vol("hg", "lo", "1.0")}, 4) AS cost FROM own JOIN t USING (g, h)""")
def flow_cost_full(spark, folder):
    z, f = _flows(spark, folder)
    return flow_costs(z.select("run_key", "id"), S.polygon_neighbours(z, "rook"), f, full=True).withColumn("cost", F.round("cost", 4))


# ---- Dirichlet evidence ----------------------------------------------------------------------------------------------


def _series(x: str, head: str, power: int, coefficients: list[str], back: str) -> str:
    """An asymptotic series at x + 8 and the eight steps back to x."""
    tail = " + ".join(f"({c}) / ({x} + 8) ** {2 * k + power}" for k, c in enumerate(coefficients))
    return f"({head.format(y=f'({x} + 8)')} + {tail} + list_sum(list_transform(range(8), lambda kk: {back.format(x=x)})))"


def _digamma(x: str) -> str:
    return _series(x, "ln({y}) - 0.5 / {y}", 2, ["-1 / 12.0", "1 / 120.0", "-1 / 252.0", "1 / 240.0", "-1 / 132.0"], "-1.0 / ({x} + kk)")


def _trigamma(x: str) -> str:
    return _series(x, "1.0 / {y} + 0.5 / {y} ** 2", 3, ["1 / 6.0", "-1 / 30.0", "1 / 42.0", "-1 / 30.0", "5 / 66.0"], "1.0 / ({x} + kk) ** 2")


def _parts(where: str) -> str:
    """For each component its beta, log share, exponential, gradient and the Hessian's diagonal; ta: what the Hessian has in common."""
    return f"""(SELECT *, list_transform(c, lambda r: {{'b': r.b, 'l': r.l, 'e': r.e, 'g': r.g, 'd': r.g - r.e ** 2 * {_trigamma("(r.e + 1)")} - 1}}) AS p FROM
        (SELECT *, list_transform(c0, lambda r: {{'b': r.b, 'l': r.l, 'e': r.e, 'g': r.e * (da - {_digamma("(r.e + 1)")} + r.l - 0.01) + 1}}) AS c FROM
        (SELECT *, {_digamma("a")} AS da, {_trigamma("a")} AS ta FROM
        (SELECT *, list_sum(list_transform(c0, lambda r: r.e + 1)) AS a FROM
        (SELECT id, k, mean, list_transform(list_zip(beta, mean), lambda z: {{'b': z[1], 'l': ln(z[2]), 'e': exp(z[1])}}) AS c0 FROM t WHERE {where})))))"""


@query(f"""WITH RECURSIVE q AS (SELECT l_suppkey AS id, {", ".join(f"count(*) FILTER (l_returnflag = '{a}' AND l_linestatus = '{b}') + 0.5 AS c{i}" for i, (a, b) in enumerate(X.CELLS))} FROM lineitem GROUP BY 1),
    m AS (SELECT id, list_transform([c0, c1, c2, c3, c4, c5], lambda v: (v / (c0 + c1 + c2 + c3 + c4 + c5))::DOUBLE) AS mean FROM q),
    t AS (SELECT id, 0 AS k, mean, list_transform(mean, lambda v: ln(greatest(5 / (-2 * list_sum(list_transform(mean, lambda w: w * (ln(w) - 0.01 - ln(w))))), 100 / list_min(mean)) * v - 1)) AS beta FROM m
        UNION ALL
        SELECT id, k + 1, mean, list_transform(p, lambda r: r.b - (r.g / r.d - r.e / r.d * ug / (1 / ta + eu))) FROM (SELECT *, list_sum(list_transform(p, lambda r: r.e / r.d * r.g)) AS ug, list_sum(list_transform(p, lambda r: r.e ** 2 / r.d)) AS eu FROM {_parts("k < 25")})),
    z AS (SELECT * FROM {_parts("k = 25")})
    SELECT id, round(list_sum(list_transform(p, lambda r: r.e * (r.l - 0.01) + ln(0.01) - lgamma(r.e + 1) + r.b - 0.5 * ln(abs(r.d)))) + lgamma(a) + 3 * ln(2 * pi()) - 0.5 * ln(1 + ta * list_sum(list_transform(p, lambda r: r.e ** 2 / r.d))), 4) AS evidence FROM z""")
def dirichlet_evidence(spark, folder):
    """The evidence of each supplier's composition, by Newton steps to the mode."""
    p = X.profiles(spark, folder)
    return p.select("id", F.round(evidence_col(F.lit(1), F.transform("shares", lambda v: F.log(v)), F.col("shares")), 4).alias("evidence"))


# ---- checks ----------------------------------------------------------------------------------------------------------


def _said(call) -> str:
    """What a call's error says, or `accepted`."""
    try:
        call()
    except ValueError as e:
        return str(e).replace("'", "")
    return "accepted"


@query("""SELECT * FROM (VALUES ('method ward', 'accepted'), ('method of a function', 'accepted'), ('method ward.D', 'method not recognized'), ('scaling raw', 'accepted'), ('scaling unit', 'scaling must be zscore or raw'),
    ('kind of zones', 'polygon'), ('kind of roads', 'line'), ('points for polygons', 'The dataset must contain only polygon geometries.'), ('no geometry', 'The dataset must be an object with a geometry of points, lines or polygons.'),
    ('columns without geometry', 'id,nodep,velo'), ('missing features', 'Some regions have missing values and missing values are not allowed.'), ('parted graph', 'The graph is not connected, several components found.')) t("check", said)""")
def checks(spark, folder):
    """What the checks before a fit say."""
    z, r = X.zones(spark, folder), X.roads(spark, folder)
    p = spark.createDataFrame([(0, i, {"x": float(i), "y": 0.0}) for i in range(3)], "run_key bigint, id bigint, geometry struct<x: double, y: double>")
    few = z.select("id", "nodep", "velo", "geometry")
    said = [
        ("method ward", _said(lambda: method_of("ward"))),
        ("method of a function", _said(lambda: method_of(lambda: Method("bayes_mom", beta=2.0)))),
        ("method ward.D", _said(lambda: method_of("ward.D"))),
        ("scaling raw", _said(lambda: P.scaled(few, ["nodep"], "raw"))),
        ("scaling unit", _said(lambda: P.scaled(few, ["nodep"], "unit"))),
        ("kind of zones", S.geometry_kind(z)),
        ("kind of roads", S.geometry_kind(r)),
        ("points for polygons", _said(lambda: S.require_kind(p, "polygon"))),
        ("no geometry", _said(lambda: S.geometry_kind(z.select(F.col("nodep").alias("geometry"))))),
        ("columns without geometry", ",".join(P.numeric_columns(few.drop("geometry")))),
        ("missing features", _said(lambda: P.require_complete(z, ["nodep", "velo"]))),
        ("parted graph", _said(lambda: G.require_connected(p, spark.createDataFrame([(0, 0, 1)], "run_key bigint, src bigint, dst bigint")))),
    ]
    return spark.createDataFrame(said, "check string, said string")


# ---- spanning trees --------------------------------------------------------------------------------------------------


def _eliminated(parts: str, edges: str) -> str:
    """CTE `trees` (key, ln_trees) of graphs whose nodes (key, i) and weighted edges (key, u, v, w) are numbered by i: nodes are eliminated in order."""
    return f"""pt AS ({parts}), pe AS ({edges}),
    st AS (SELECT key, (SELECT list(i ORDER BY i) FROM pt y WHERE y.key = x.key) AS todo, coalesce((SELECT list({{'u': u, 'v': v, 'w': w}}) FROM pe WHERE pe.key = x.key), []) AS e FROM (SELECT DISTINCT key FROM pt) x),
    el AS (SELECT key, todo, e, 0.0::DOUBLE AS ln_trees FROM st
        UNION ALL
        SELECT key, todo[2:], list_concat(list_filter(e, lambda q: q.u <> todo[1] AND q.v <> todo[1]),
            flatten(list_transform(mine, lambda a, i: list_transform(mine[i + 1:], lambda b: {{'u': a.j, 'v': b.j, 'w': a.w * b.w / whole}})))), ln_trees + ln(whole)
        FROM (SELECT *, list_sum(list_transform(mine, lambda q: q.w)) AS whole FROM (SELECT *, list_transform(near, lambda k: {{'j': k, 'w': list_sum(list_transform(list_filter(own, lambda q: q.j = k), lambda q: q.w))}}) AS mine FROM
            (SELECT *, list_sort(list_distinct(list_transform(own, lambda q: q.j))) AS near FROM
            (SELECT *, list_transform(list_filter(e, lambda q: q.u = todo[1] OR q.v = todo[1]), lambda q: {{'j': CASE WHEN q.u = todo[1] THEN q.v ELSE q.u END, 'w': q.w}}) AS own FROM el WHERE len(todo) > 1))))),
    trees AS (SELECT key, ln_trees FROM el WHERE len(todo) = 1)"""


_TOPS = 12


@query(f"""{ZONE_SEGMENTS.replace('WITH', 'WITH RECURSIVE', 1)}, {M.tree("ward", ZONE_LEAVES, ZONE_EDGES["rook"])}, {M.cuts(M.upto(*range(1, _TOPS + 1)))},
    en AS (SELECT a.k, a.cl AS ca, b.cl AS cb, u, v FROM ends JOIN cuts a ON a.i = u JOIN cuts b ON b.i = v AND b.k = a.k),
    {_eliminated("SELECT k * 100 + cl AS key, i FROM cuts UNION ALL SELECT DISTINCT -k, cl FROM cuts", "SELECT k * 100 + ca AS key, u, v, 1.0::DOUBLE AS w FROM en WHERE ca = cb UNION ALL SELECT -k, least(ca, cb), greatest(ca, cb), count(*)::DOUBLE FROM en WHERE ca <> cb GROUP BY ALL")}
    SELECT 0::BIGINT AS run_key, k::INTEGER AS k, round(intra, 5) AS intra, round(ln_trees + 1e-9, 5) AS inter FROM (SELECT key // 100 AS k, sum(ln_trees) AS intra FROM trees WHERE key > 0 GROUP BY 1) JOIN trees ON key = -k""")
def sptree_prior_zones_ward(spark, folder):
    """Spanning trees within and between the clusters of each cut of the zones into 1 to 12."""
    z = X.zones(spark, folder)
    edges = S.polygon_neighbours(z, "rook")
    t = fit_graph(_zone_counts(z), edges)
    return T.tree_prior(t, edges, _TOPS).select("run_key", "k", F.round("intra", 5).alias("intra"), F.round(F.col("inter") + 1e-9, 5).alias("inter"))


@query("SELECT n::BIGINT AS run_key, round(ln(n / 2.0) + 1e-9, 6) AS cost FROM range(4, 60) t(n)")
def cut_costs(spark, folder):
    """Rings of n nodes cut in two: n trees in the ring, one in each half, two edges cut."""
    nodes = spark.range(4, 60).select(F.col("id").alias("run_key"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id") - 1)).alias("node"))
    edges = nodes.select("run_key", F.col("node").alias("src"), F.pmod(F.col("node") + 1, F.col("run_key")).alias("dst"))
    labels = nodes.select("run_key", F.col("node").alias("id"), F.when(F.col("node") * 3 < F.col("run_key"), 1).otherwise(2).alias("cl"))
    return T.cut_cost(edges, labels).select("run_key", F.round(F.col("cost") + 1e-9, 6).alias("cost"))


# ---- regression ------------------------------------------------------------------------------------------------------

_MEAN = {"poisson": "exp({e})", "gamma": "exp({e})", "binomial": "(1 / (1 + exp(-({e}))))"}
_WEIGHT = {"poisson": "{m}", "gamma": "1.0", "binomial": "({m} * (1 - {m}))"}
_REST = {"poisson": "(y - {m})", "gamma": "(y / {m} - 1)", "binomial": "(y - {m})"}
_LIK = {"poisson": "({e}) * y - exp({e}) - lgamma(y + 1)", "gamma": "-y * exp(-({e})) - ({e})", "binomial": "({e}) * y - ln(1 + exp({e}))"}


def _det(a: list[list[str]]) -> str:
    m = lambda i, j: a[i][j]
    return f"({m(0, 0)} * ({m(1, 1)} * {m(2, 2)} - {m(1, 2)} * {m(2, 1)}) - {m(0, 1)} * ({m(1, 0)} * {m(2, 2)} - {m(1, 2)} * {m(2, 0)}) + {m(0, 2)} * ({m(1, 0)} * {m(2, 1)} - {m(1, 1)} * {m(2, 0)}))"


def _glm_sql(family: str, y: str, steps: int = 40) -> str:
    """Newton steps with a ridge of 0.01 for two features and an intercept, each group's rows held as a list."""
    e = "(b0 + b1 * r.a + b2 * r.c)"
    m = _MEAN[family].format(e=e)
    w = _WEIGHT[family].format(m=m)
    rest = _REST[family].format(m=m).replace("y", "r.y")
    x = ["1.0", "r.a", "r.c"]
    total = lambda of: f"list_sum(list_transform(d, lambda r: {of}))"
    h = ", ".join(f"{total(f'{w} * {x[i]} * {x[j]}')}{' + 0.01' if i == j else ''} AS h{i}{j}" for i in range(3) for j in range(i, 3))
    g = ", ".join(f"{total(f'{rest} * {x[i]}')} - 0.01 * b{i} AS g{i}" for i in range(3))
    a = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    step = [f"b{k} + {_det([[f'g{i}' if j == k else a[i][j] for j in range(3)] for i in range(3)])} / {_det(a)}" for k in range(3)]
    lik = _LIK[family].format(e=e).replace("y", "r.y").replace("lgamma(r.r.y", "lgamma(r.y")
    return f"""WITH RECURSIVE q AS (SELECT l_suppkey AS id, list({{'a': l_discount::DOUBLE, 'c': l_tax::DOUBLE, 'y': {y}}}) AS d FROM lineitem GROUP BY 1),
    t AS (SELECT id, d, 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM q
        UNION ALL SELECT id, d, k + 1, {step[0]}, {step[1]}, {step[2]} FROM (SELECT *, {h}, {g} FROM t WHERE k < {steps})),
    z AS (SELECT *, {h} FROM t WHERE k = {steps})
    SELECT id, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round({total(lik)} + 1.5 * ln(2 * pi()) - 0.5 * ln({_det(a)}), 3) AS evidence, len(d)::BIGINT AS n FROM z"""


def _glm(family: str, y: str, column: str) -> None:
    def run(spark, folder):
        rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id"), "l_discount", "l_tax", F.expr(column).cast("double").alias("y"))
        return fit_groups(rows, "id", ["l_discount", "l_tax"], "y", family=family).select("id", *[F.round(F.col("beta")[i], 4).alias(f"b{i}") for i in range(3)], F.round("evidence", 3).alias("evidence"), "n")

    run.__name__ = f"glm_{family}"
    query(_glm_sql(family, y))(run)


_glm("poisson", "l_quantity::DOUBLE", "l_quantity")
_glm("binomial", "(l_returnflag = 'R')::INTEGER::DOUBLE", "int(l_returnflag = 'R')")
_glm("gamma", "l_extendedprice::DOUBLE / 10000", "double(l_extendedprice) / 10000")


# ---- files, joins, tests, streams ------------------------------------------------------------------------------------


@query("SELECT CODE_IRIS, INSEE_COM, DEP, nodep, velo, perimetre FROM zones")
def csv_source(spark, folder):
    """The zones' attributes written as delimited text and read again."""
    path = f"{shared_folder(spark)}/zones-{uuid.uuid4().hex}.csv"
    cols = ["CODE_IRIS", "INSEE_COM", "DEP", "nodep", "velo", "perimetre"]
    write(table(spark, folder, "zones").select(*cols), path, "csv", sep=";", header=True)
    return read_csv(spark, path, "CODE_IRIS string, INSEE_COM string, DEP string, nodep double, velo double, perimetre int")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def parquet_sink(spark, folder):
    """Events written by type, and read again from the parts."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    write(table(spark, folder, "events").select("event_id", "event_type", "value"), path, by=["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH a AS (SELECT trim(Origine) AS k, sum(Volume) AS vol FROM ods WHERE NOT isnan(Volume) GROUP BY 1)
    SELECT CODE_IRIS, substr(CODE_IRIS, 1, 2) AS dep, len(geometry) AS rings, round(vol, 5) AS vol FROM zones LEFT JOIN a ON trim(regroupement_desc) = k""")
def geometry_attributes(spark, folder):
    """Zones with the volume that leaves them; zones that nothing leaves stay."""
    out = table(spark, folder, "ods").where("not isnan(Volume)").groupBy(F.trim("Origine").alias("k")).agg(F.sum("Volume").alias("vol"))
    both = with_attributes(table(spark, folder, "zones"), out, "regroupement_desc", "k")
    return both.select("CODE_IRIS", F.substring("CODE_IRIS", 1, 2).alias("dep"), F.size("geometry").cast("bigint").alias("rings"), F.round("vol", 5).alias("vol"))


@query("""WITH d AS (SELECT user_id, value - lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), n AS (SELECT user_id, d FROM d WHERE d <> 0),
    r AS (SELECT user_id, d, (rank() OVER (PARTITION BY user_id ORDER BY abs(d)) + count(*) OVER (PARTITION BY user_id ORDER BY abs(d))) / 2.0 AS r, count(*) OVER (PARTITION BY user_id, abs(d)) AS t FROM n)
    SELECT user_id, count(*) AS n, sum(r) FILTER (d > 0) AS v, round((sum(r) FILTER (d > 0) - count(*) * (count(*) + 1) / 4.0 - 0.5) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - sum(t * t - 1) / 48.0), 6) AS z FROM r GROUP BY 1""")
def signed_rank(spark, folder):
    """Whether a user's values are greater than those that follow them."""
    p = X.consecutive(X.chains(spark, folder), ["value"]).withColumnRenamed("run_key", "user_id")
    return W.signed_rank(p, "user_id", "a_value", "b_value").select("user_id", "n", "v", F.round("z", 6).alias("z"))


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_windows(spark, folder):
    """Events as a stream of files: counts and means by type and window of event time, as the stream stands at its end."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    windows = tumbling(stream, "ts", "event_type", "value", "6 hours", "1 day")
    q = windows.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, n: write(df, f"{base}/out", mode="overwrite")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_type", "start", "n", F.round("mean", 6).alias("mean"))
