"""The model's tables, derived from the test tables by integer arithmetic on their keys, in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import BANDS
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
YEARS = (1995, 2001)
BASINS = ("WP", "EP", "NA", "NI", "SI", "SP", "SA")


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def storm_events(spark: SparkSession, root: str) -> DataFrame:
    """orders as events: a year, a hemisphere and basin by customer, a latitude by key, an intensity by price."""
    o = table(spark, root, "orders")
    south = F.col("o_custkey") % 2 == 1
    lat = F.when(south, -1.0).otherwise(1.0) * (F.col("o_orderkey") * 7 % 600) / 10
    return o.select(
        "o_orderkey", F.concat(F.lit("S"), F.col("o_custkey") % 40).alias("SID"), F.col("o_orderdate").alias("TIME"), F.year("o_orderdate").alias("YEAR"),
        F.when(south, "SH").otherwise("NH").alias("HEMISPHERE"), F.get(F.array(*map(F.lit, BASINS)), (F.col("o_custkey") % 7).cast("int")).alias("BASIN"),
        lat.alias("TC_LAT"), (F.col("o_totalprice") / 1000).alias("EVENT_INTENSITY_MM_3H"),
    )


EVENTS = """ev AS (
  SELECT o_orderkey, 'S' || (o_custkey % 40) AS SID, o_orderdate AS TIME, year(o_orderdate)::INT AS YEAR,
         CASE WHEN o_custkey % 2 = 1 THEN 'SH' ELSE 'NH' END AS HEMISPHERE,
         ['WP', 'EP', 'NA', 'NI', 'SI', 'SP', 'SA'][o_custkey % 7 + 1] AS BASIN,
         (CASE WHEN o_custkey % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE * (o_orderkey * 7 % 600) / 10 AS TC_LAT,
         o_totalprice / 1000 AS EVENT_INTENSITY_MM_3H
  FROM orders)"""


def wet_samples(spark: SparkSession, root: str, e: DataFrame | None = None) -> DataFrame:
    """events (`e`, if they are read otherwise) as cells of storms: a row by user, a three-hour step, a single-precision value."""
    e = table(spark, root, "events") if e is None else e
    tick = F.make_timestamp_ntz(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), (F.floor(F.hour("ts") / 3) * 3).cast("int"), F.lit(0), F.lit(0))
    return e.select(
        "event_id", (F.col("user_id") % 100).cast("int").alias("ROW"), F.concat(F.lit("S"), F.col("user_id") % 25).alias("SID"), tick.alias("TIME"), F.lit("WP").alias("BASIN"),
        ((F.col("user_id") % 25).cast("double") - 12).cast("float").alias("TC_LAT"), F.col("value").cast("float").alias("PRECIP_3H_MM"), (F.col("event_id") % 97 == 0).alias("IS_INTERPOLATED_TIMESTEP"),
    )


CELLS = """ce AS (
  SELECT event_id, (user_id % 100)::INT AS ROW, 'S' || (user_id % 25) AS SID, time_bucket(INTERVAL 3 HOURS, ts) AS TIME, 'WP' AS BASIN,
         ((user_id % 25)::DOUBLE - 12)::FLOAT AS TC_LAT, value::FLOAT AS PRECIP_3H_MM, event_id % 97 = 0 AS IS_INTERPOLATED_TIMESTEP
  FROM events)"""


def band_sql(lat: str, hemi: str) -> str:
    """A CASE for the band number, written from the edges."""
    out = "CASE"
    for h, e in BANDS.items():
        for k in range(len(e) - 1):
            out += f" WHEN {hemi} = '{h}' AND abs({lat}) >= {e[k]} AND abs({lat}) < {e[k + 1]} THEN {k}"
    return out + " ELSE -1 END"


BAND_TABLE = (
    EVENTS
    + f""",
sums AS (SELECT HEMISPHERE, YEAR, {band_sql("TC_LAT", "HEMISPHERE")} AS BAND, count(*)::BIGINT AS n, sum(EVENT_INTENSITY_MM_3H) AS v FROM ev GROUP BY ALL),
grid AS (SELECT h AS HEMISPHERE, y::INT AS YEAR, b::INT AS BAND FROM (SELECT DISTINCT HEMISPHERE AS h FROM ev), generate_series(1995, 2001) t(y), generate_series(0, 3) u(b)),
ab AS (SELECT HEMISPHERE, YEAR, BAND, coalesce(n, 0)::BIGINT AS n, coalesce(v, 0.0) AS v FROM grid LEFT JOIN sums USING (HEMISPHERE, YEAR, BAND))"""
)

COMPONENTS = (
    BAND_TABLE
    + """,
c0 AS (SELECT *, n / sum(n) OVER (PARTITION BY HEMISPHERE, YEAR) AS a, v / nullif(n, 0) AS m FROM ab),
c1 AS (SELECT *, avg(a) OVER (PARTITION BY HEMISPHERE, BAND) AS a0, avg(m) OVER (PARTITION BY HEMISPHERE, BAND) AS m0 FROM c0),
c2 AS (SELECT HEMISPHERE, YEAR, a, coalesce(m, m0) AS m, a0, m0 FROM c1),
co AS (SELECT HEMISPHERE, YEAR, sum(a * m) AS ANNUAL_MEAN, sum(a0 * m0) AS REFERENCE, sum((a - a0) * m0) AS REDISTRIBUTION,
              sum(a0 * (m - m0)) AS WITHIN_BAND, sum((a - a0) * (m - m0)) AS INTERACTION FROM c2 GROUP BY ALL)"""
)

LONG_COMPONENTS = (
    COMPONENTS
    + """,
lc AS (SELECT HEMISPHERE, YEAR, 'TOTAL' AS COMPONENT, ANNUAL_MEAN AS value FROM co UNION ALL SELECT HEMISPHERE, YEAR, 'REDISTRIBUTION', REDISTRIBUTION FROM co
       UNION ALL SELECT HEMISPHERE, YEAR, 'WITHIN_BAND', WITHIN_BAND FROM co UNION ALL SELECT HEMISPHERE, YEAR, 'INTERACTION', INTERACTION FROM co)"""
)


def _odd_logs() -> str:
    import math

    total, out = 0.0, []
    for n in range(61):
        total += math.log(2 * n + 1)
        out.append(repr(total))
    return "[" + ", ".join(out) + "]::DOUBLE[]"


def erfc_sql(x: str) -> str:
    """erfc of a number >= 0: a series in logarithms below 2.5, a continued fraction from there."""
    series = f"list_sum(list_transform(generate_series(0, 60), lambda n: exp(n * ln(2 * ({x}) * ({x})) + ln({x}) - ({_odd_logs()})[n + 1])))"
    fraction = f"list_reduce(list_transform(generate_series(60, 1, -1), lambda n: n::DOUBLE), lambda a, n: ({x}) + n / 2 / a, ({x}))"
    return f"CASE WHEN ({x}) = 0 THEN 1.0 WHEN ({x}) < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {series} ELSE exp(-({x}) * ({x})) / sqrt(pi()) / {fraction} END"


def trend_sql(source: str, keys: str, y: str, t: str = "YEAR", per: str = "10") -> str:
    """CTEs sl (keys, slope) and mk (keys, n, s, var, z, p_value) over a CTE of points."""
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
pt AS (SELECT {keys}, {t} AS t, {y} AS y FROM {source} WHERE {y} IS NOT NULL),
pr AS (SELECT {ak}, (b.y - a.y) / (b.t - a.t) AS q, sign(b.y - a.y) AS sg FROM pt a JOIN pt b ON {on} AND a.t < b.t),
nn AS (SELECT {keys}, count(*)::BIGINT AS n FROM pt GROUP BY ALL),
tg AS (SELECT {keys}, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT {keys}, y, count(*) AS c FROM pt GROUP BY ALL) GROUP BY ALL),
sl AS (SELECT {keys}, CASE WHEN any_value(n) >= 3 THEN {per} * quantile_cont(q, 0.5) END AS slope FROM nn LEFT JOIN pr USING ({keys}) GROUP BY {keys}),
sx AS (SELECT {keys}, any_value(n) AS n, coalesce(sum(sg), 0)::DOUBLE AS s FROM nn LEFT JOIN pr USING ({keys}) GROUP BY {keys}),
vx AS (SELECT {keys}, n, s, (n::DOUBLE * (n - 1) * (2 * n + 5) - tie) / 18 AS var FROM sx JOIN tg USING ({keys})),
zx AS (SELECT *, CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) END AS z FROM vx),
mk AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN var <= 0 THEN 1.0 ELSE {erfc_sql("abs(z) / sqrt(2)")} END AS p_value FROM zx)"""
