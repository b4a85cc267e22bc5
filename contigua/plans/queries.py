"""Queries of the core operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.operators.fill import Category, Numeric, fill_missing
from contigua.operators.near import near_pairs
from contigua.operators.spikes import implausible
from contigua.plans import step_queries
from contigua.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(table(spark, folder, "nodes"), 25.0)


def p3_spikes(spark: SparkSession, folder: str) -> DataFrame:
    return implausible(table(spark, folder, "speeds_long"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_spikes(spark, folder).select("obs_id").distinct()


#: The road classes and days that count as named; fixed values.
ROAD_CLASSES = ["trunk", "primary", "secondary", "tertiary", "residential", "service"]
DAYS = ["D7", "D8", "D9"]


def p4_fill(spark: SparkSession, folder: str) -> DataFrame:
    speed, day = F.col("speed"), F.col("day")
    road = F.lower(F.regexp_replace("road_class", r"\s+", ""))
    return fill_missing(
        table(spark, folder, "speeds_long"),
        source="link_id",
        ts="ts",
        row_id="obs_id",
        numerics=[Numeric("speed", F.when(~F.isnan(speed) & (speed != 0), speed))],
        categories=[
            Category("day", F.when(day.isin(DAYS), day), gap_s=1_800.0, by_date=True, default=F.concat(F.lit("D"), F.dayofmonth(F.date_from_unix_date(F.floor(F.col("us") / 86_400_000_000).cast("int"))))),
            Category("road_class", F.when(road.isin(ROAD_CLASSES), road), gap_s=86_400.0, by_source=True),
        ],
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    filled = p4_fill(spark, folder).where("link_id is not null")
    fields = F.filter(F.array(*[F.when(F.col(f"{c}_filled"), c) for c in ("speed", "day", "road_class")]), lambda x: x.isNotNull())
    return filled.select("obs_id", F.explode(fields).alias("field_name")).distinct()


QUERIES: dict[str, Query] = step_queries.QUERIES | {"p2_found": p2_found, "p3_found": p3_found, "p3_spikes": p3_spikes, "p4_found": p4_found, "p4_fill": p4_fill}

_NUMBER = "CASE WHEN isnan(speed) OR speed = 0 THEN NULL ELSE speed END"

#: Plain rules: neighbours compared directly, the scatter from readings about their neighbours' mean, trimmed in rounds.
_SPIKES = f"""WITH d AS (SELECT DISTINCT obs_id, link_id, ts, CAST(ts AS DATE) AS day, speed AS x FROM speeds_long WHERE link_id IS NOT NULL AND ts IS NOT NULL AND {_NUMBER} IS NOT NULL),
    a AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY link_id, day, x ORDER BY ts, obs_id) AS run FROM d WINDOW w AS (PARTITION BY link_id, day ORDER BY ts, obs_id)),
    s AS (SELECT *, count(*) OVER (PARTITION BY link_id, day, x, run) >= 6 AS stuck FROM a),
    p AS (SELECT * FROM s WHERE x BETWEEN 0 AND 55),
    m AS (SELECT link_id, x - (lag(x) OVER w + lead(x) OVER w) / 2 AS e, stuck OR lag(stuck) OVER w OR lead(stuck) OVER w AS skip FROM p WINDOW w AS (PARTITION BY link_id, day ORDER BY ts, obs_id)),
    e AS (SELECT link_id, abs(e) AS e FROM m WHERE e IS NOT NULL AND NOT skip),
    s0 AS (SELECT link_id, greatest(median(e) * 1.4826, 0.001) AS sd FROM e GROUP BY 1),
    s1 AS (SELECT link_id, greatest(sqrt(avg(e * e)), 0.001) AS sd FROM e JOIN s0 USING (link_id) WHERE e <= 3.5 * sd GROUP BY 1),
    s2 AS (SELECT link_id, greatest(sqrt(avg(e * e)), 0.001) AS sd FROM e JOIN s1 USING (link_id) WHERE e <= 3.5 * sd GROUP BY 1),
    need AS (SELECT link_id, greatest(4, 8 * sd / sqrt(1.5)) AS need FROM s2),
    r AS (SELECT obs_id, link_id, day, coalesce(need, 4) AS need, x, lag(x) OVER w AS b, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3, lead(obs_id) OVER w AS o1, lead(obs_id, 2) OVER w AS o2 FROM p LEFT JOIN need USING (link_id) WINDOW w AS (PARTITION BY link_id, day ORDER BY ts, obs_id)),
    f AS (SELECT obs_id, o1, o2, 1 AS k FROM r WHERE x - greatest(b, x1) >= need - 1e-9 AND x1 IS NOT NULL AND b IS NOT NULL OR least(b, x1) - x >= need - 1e-9 AND x1 IS NOT NULL AND b IS NOT NULL
        UNION ALL SELECT obs_id, o1, o2, 2 FROM r WHERE b IS NOT NULL AND x2 IS NOT NULL AND (least(x, x1) - greatest(b, x2) >= need - 1e-9 OR least(b, x2) - greatest(x, x1) >= need - 1e-9)
        UNION ALL SELECT obs_id, o1, o2, 3 FROM r WHERE b IS NOT NULL AND x3 IS NOT NULL AND (least(x, x1, x2) - greatest(b, x3) >= need - 1e-9 OR least(b, x3) - greatest(x, x1, x2) >= need - 1e-9)),
    found AS (SELECT obs_id, 'impossible' AS kind FROM s WHERE x < 0 OR x > 55 UNION ALL SELECT obs_id, 'stuck' FROM s WHERE stuck UNION ALL SELECT obs_id, 'spike' FROM f UNION ALL SELECT o1, 'spike' FROM f WHERE k > 1 UNION ALL SELECT o2, 'spike' FROM f WHERE k > 2)
"""

_FILL = f"""WITH v AS (SELECT obs_id, link_id, ts, CAST(ts AS DATE) AS d, {_NUMBER} AS speed FROM speeds_long WHERE link_id IS NOT NULL),
    w AS (SELECT *, last_value(CASE WHEN speed IS NOT NULL THEN {{'t': ts, 'v': speed}} END IGNORE NULLS) OVER (PARTITION BY link_id, d ORDER BY ts, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
        first_value(CASE WHEN speed IS NOT NULL THEN {{'t': ts, 'v': speed}} END IGNORE NULLS) OVER (PARTITION BY link_id, d ORDER BY ts, obs_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM v),
    g AS (SELECT *, epoch_us(ts) - epoch_us(p.t) AS back, epoch_us(q.t) - epoch_us(ts) AS ahead FROM w)
    SELECT DISTINCT obs_id, round(CASE WHEN speed IS NOT NULL THEN speed WHEN p IS NULL THEN q.v WHEN q IS NULL THEN p.v ELSE p.v + (q.v - p.v) * CASE WHEN back + ahead > 0 THEN back / (back + ahead) ELSE 0 END END + 3.3e-7, 4) AS speed,
        CASE WHEN speed IS NOT NULL THEN NULL WHEN p IS NULL AND q IS NULL THEN NULL WHEN p IS NULL THEN 'next' WHEN q IS NULL THEN 'previous' ELSE 'interpolated' END AS speed_method,
        CASE WHEN speed IS NULL THEN round(least(back, ahead) / 1e6, 3) END AS speed_distance_s FROM g"""


def p4_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """The speeds after filling, each with its method and distance."""
    filled = p4_fill(spark, folder).where("link_id is not null")
    return filled.select("obs_id", F.round(F.col("speed") + 3.3e-7, 4).alias("speed"), "speed_method", F.round("speed_distance_s", 3).alias("speed_distance_s")).distinct()


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings are of each kind; one that is of several counts as the first of impossible, stuck and spike."""
    return p3_spikes(spark, folder).groupBy("kind").agg(F.count_distinct("obs_id").alias("n"))


QUERIES |= {"p3_kinds": p3_kinds, "p4_speeds": p4_speeds}

SQL: dict[str, str] = step_queries.SQL | {
    "p2_found": """
        WITH p AS (SELECT DISTINCT id, x, y FROM nodes WHERE isfinite(x) AND isfinite(y) AND NOT (x = 0 AND y = 0))
        SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b
        ON a.id < b.id AND b.x BETWEEN a.x - 26 AND a.x + 26 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 625.0""",
    "p3_found": _SPIKES + "SELECT DISTINCT obs_id FROM found",
    "p3_kinds": _SPIKES + "SELECT CASE kind WHEN 'z' THEN 'spike' ELSE kind END AS kind, count(*) AS n FROM (SELECT obs_id, min(kind) AS kind FROM (SELECT obs_id, CASE kind WHEN 'spike' THEN 'z' ELSE kind END AS kind FROM found) GROUP BY 1) GROUP BY kind",
    "p4_speeds": _FILL,
    "p4_found": """
        WITH r AS (SELECT obs_id, link_id, CAST(ts AS DATE) AS d,
            CASE WHEN isnan(speed) OR speed = 0 THEN NULL ELSE speed END AS speed,
            CASE WHEN day IN ('D7', 'D8', 'D9') THEN day END AS day,
            CASE WHEN lower(replace(road_class, ' ', '')) IN ('trunk', 'primary', 'secondary', 'tertiary', 'residential', 'service') THEN road_class END AS rc
            FROM speeds_long WHERE link_id IS NOT NULL)
        SELECT DISTINCT obs_id, 'day' AS field_name FROM r WHERE day IS NULL
        UNION ALL SELECT DISTINCT obs_id, 'speed' FROM r WHERE speed IS NULL AND (link_id, d) IN (SELECT (link_id, d) FROM r WHERE speed IS NOT NULL)
        UNION ALL SELECT DISTINCT obs_id, 'road_class' FROM r WHERE rc IS NULL AND link_id IN (SELECT link_id FROM r WHERE rc IS NOT NULL)""",
}
