"""Queries: tables behind figures and supplements, the release's verification, audits of cells and grids, files."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import row_lat, row_lon
from ..functions.scalars import BASIN_NAMES, display_basin, recoded_basin
from ..operators import audit, bands, bootstrap, decompose, events, features, report
from ..session import shared_dir
from ..sources import files
from ..sources.tables import table
from . import figures
from ..streaming import incremental
from .base import BASINS, EVENTS, ORACLE, YEARS, band_sql, query, storm_events, trend_sql, wet_samples
from .records import EVENT_SQL, STAMP, STORMS, all_raw_rows, event_columns, local_thresholds, stamp, storm_fields
from .series import BAND_BOOT, COUNTS, DEGREE, DOMAINS, HOW, SURFACE, _cell_sql, _draws_sql, _terms_sql, domain_bands, hemi_bands, parts, r, surface_bands

LABEL = "CASE WHEN HEMISPHERE = 'NH' THEN ['0-15', '15-25', '25-35', '35-90'][BAND + 1] ELSE ['0-10', '10-15', '15-20', '20-90'][BAND + 1] END AS BAND_LABEL"
FITTED = ("fit", "fit_lower", "fit_upper", "slope", "p_value")


def fit_sql(source: str, keys: str, y: str) -> str:
    """CTEs fb (keys, YEAR, fit, fit_lower, fit_upper) of Sen lines with joint intercepts, sl and mk of their trends."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""{trend_sql(source, keys, y)},
f0 AS (SELECT {keys}, YEAR, row_number() OVER (PARTITION BY {keys} ORDER BY YEAR) - 1 AS pos, {y} AS y FROM {source}),
f1 AS (SELECT {of("f0")}, any_value(slope) / 10 AS s, quantile_cont(y - slope / 10 * YEAR, 0.5) AS ic FROM f0 JOIN sl ON {on("f0", "sl")} GROUP BY {of("f0")}),
f2 AS (SELECT {of("f0")}, YEAR, pos, ic + s * YEAR AS fit, y - (ic + s * YEAR) AS res FROM f0 JOIN f1 ON {on("f0", "f1")}),
{_draws_sql(YEARS[1] - YEARS[0] + 1)},
f3 AS (SELECT {of("a")}, REP, a.YEAR, a.fit + b.res AS y FROM bi JOIN f2 a ON a.pos = bi.POS JOIN f2 b ON {on("a", "b")} AND b.pos = bi.SRC),
f4 AS (SELECT {of("a")}, a.REP, quantile_cont((b.y - a.y) / (b.YEAR - a.YEAR), 0.5) AS s FROM f3 a JOIN f3 b ON {on("a", "b")} AND a.REP = b.REP AND a.YEAR < b.YEAR GROUP BY ALL),
f5 AS (SELECT {of("f3")}, f3.REP, any_value(s) AS s, quantile_cont(y - s * YEAR, 0.5) AS ic FROM f3 JOIN f4 ON {on("f3", "f4")} AND f3.REP = f4.REP GROUP BY ALL),
f6 AS (SELECT {keys}, yr::INT AS YEAR, quantile_cont(ic + s * yr, 0.025) AS lo, quantile_cont(ic + s * yr, 0.975) AS hi FROM f5, generate_series({YEARS[0]}, {YEARS[1]}) t(yr) GROUP BY ALL),
fb AS (SELECT {of("f2")}, f2.YEAR, fit, lo AS fit_lower, hi AS fit_upper FROM f2 JOIN f6 ON {on("f2", "f6")} AND f2.YEAR = f6.YEAR)"""


def rounds(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# --- figures ----------------------------------------------------------------------------------------------


@query(
    f"""WITH {EVENTS}, g AS (SELECT coalesce(HEMISPHERE, 'GLOBAL') AS domain, YEAR, count(*)::BIGINT AS n, avg(EVENT_INTENSITY_MM_3H) AS mean FROM ev WHERE YEAR BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY GROUPING SETS ((YEAR), (HEMISPHERE, YEAR))),
{fit_sql("g", "domain", "mean")}
SELECT domain, YEAR, g.n, round(mean, 6) AS mean, {rounds(*FITTED)} FROM g JOIN fb USING (domain, YEAR) JOIN sl USING (domain) JOIN mk USING (domain)"""
)
def figure_annual_series(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root)
    return figures.annual_series(ev, YEARS, **HOW).select("domain", "YEAR", "n", *r("mean", *FITTED))


@query(f"WITH {EVENTS} SELECT HEMISPHERE, BAND, {LABEL}, EVENT_INTENSITY_MM_3H FROM (SELECT *, {band_sql('TC_LAT', 'HEMISPHERE')} AS BAND FROM ev)")
def figure_samples(spark: SparkSession, root: str) -> DataFrame:
    return figures.samples(storm_events(spark, root))


@query(
    f"""WITH {EVENTS}, s AS (SELECT HEMISPHERE, {band_sql("TC_LAT", "HEMISPHERE")} AS BAND, EVENT_INTENSITY_MM_3H AS v FROM ev)
SELECT HEMISPHERE, BAND, {", ".join(f"round(quantile_cont(v, {q / 100}), 9) AS q{q}" for q in (10, 50, 90, 99))} FROM s GROUP BY ALL"""
)
def figure_band_quantiles(spark: SparkSession, root: str) -> DataFrame:
    return figures.band_quantiles(storm_events(spark, root)).select("HEMISPHERE", "BAND", *r("q10", "q50", "q90", "q99", digits=9))


@query(
    f"""WITH {EVENTS}, lt AS (SELECT 'event' AS record_type, CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END AS domain, YEAR, abs(TC_LAT) AS l FROM ev UNION ALL
  SELECT 'track', CASE WHEN TC_LAT / 2 >= 0 THEN 'NH' ELSE 'SH' END, YEAR, abs(TC_LAT / 2) FROM ev),
g AS (SELECT record_type, domain, YEAR, avg(l) AS mean_lat, count(*)::BIGINT AS n_records FROM lt GROUP BY ALL),
{fit_sql("g", "record_type, domain", "mean_lat")}
SELECT record_type, domain, YEAR, round(mean_lat, 6) AS mean_lat, n_records, {rounds(*FITTED)} FROM g JOIN fb USING (record_type, domain, YEAR) JOIN sl USING (record_type, domain) JOIN mk USING (record_type, domain)"""
)
def figure_latitude_series(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root)
    out = figures.latitude_series(ev.select((F.col("TC_LAT") / 2).alias("LAT"), "YEAR"), ev, YEARS, **HOW)
    return out.select("record_type", "domain", "YEAR", *r("mean_lat"), "n_records", *r(*FITTED))


SURFACE_SERIES = f"{EVENTS}, {SURFACE}, g AS (SELECT HEMISPHERE, SURFACE, YEAR, sum(n_j)::BIGINT AS N_t, coalesce(sum(vol_j) / nullif(sum(n_j), 0), 0) AS mean FROM sb GROUP BY ALL)"


@query(
    f"""WITH {SURFACE_SERIES}, {fit_sql("g", "HEMISPHERE, SURFACE", "mean")}
SELECT HEMISPHERE, SURFACE, YEAR, N_t, round(mean, 6) AS mean, {rounds(*FITTED)} FROM g JOIN fb USING (HEMISPHERE, SURFACE, YEAR) JOIN sl USING (HEMISPHERE, SURFACE) JOIN mk USING (HEMISPHERE, SURFACE)"""
)
def figure_surface_series(spark: SparkSession, root: str) -> DataFrame:
    return figures.surface_series(surface_bands(spark, root), **HOW).select("HEMISPHERE", "SURFACE", "YEAR", "N_t", *r("mean", *FITTED))


@query(
    f"""WITH {EVENTS}, {SURFACE}, sc AS (SELECT HEMISPHERE, SURFACE, YEAR, BAND, n_j AS n, vol_j AS v FROM sb), {_terms_sql("sc", "HEMISPHERE, SURFACE", "t")}
SELECT HEMISPHERE, SURFACE, BAND, {LABEL}, {rounds("migration", "intensity", "residual", "total")} FROM tz"""
)
def figure_surface_terms(spark: SparkSession, root: str) -> DataFrame:
    return figures.surface_terms(surface_bands(spark, root)).select("HEMISPHERE", "SURFACE", "BAND", "BAND_LABEL", *r("migration", "intensity", "residual", "total"))


# --- supplementary tables ---------------------------------------------------------------------------------


@query(
    f"""WITH {EVENTS}, s AS (SELECT HEMISPHERE, YEAR, {band_sql("TC_LAT", "HEMISPHERE")} AS BAND, EVENT_INTENSITY_MM_3H AS v FROM ev),
y AS (SELECT HEMISPHERE, BAND, avg(m) AS climatological_mean FROM (SELECT HEMISPHERE, BAND, YEAR, avg(v) AS m FROM s GROUP BY ALL) GROUP BY ALL)
SELECT HEMISPHERE, BAND, {LABEL}, round(any_value(climatological_mean), 6) AS climatological_mean, round(median(v), 6) AS pooled_median, count(*)::BIGINT AS n_events FROM s JOIN y USING (HEMISPHERE, BAND) GROUP BY HEMISPHERE, BAND"""
)
def table_baselines(spark: SparkSession, root: str) -> DataFrame:
    return figures.baselines(hemi_bands(spark, root), storm_events(spark, root)).select("HEMISPHERE", "BAND", "BAND_LABEL", *r("climatological_mean", "pooled_median"), "n_events")


def terms(spark: SparkSession, root: str) -> DataFrame:
    return bootstrap.band_intervals(domain_bands(spark, root), ["domain"], **HOW)


CELL_TABLE = f"WITH {DOMAINS}, {BAND_BOOT}, {COUNTS}, ce AS (SELECT domain, BAND, {_cell_sql()} AS cell FROM oz JOIN rz USING (domain, BAND) GROUP BY domain, BAND)"
BAND_COLUMNS = ", ".join(f"max(cell) FILTER (BAND = {k}) AS band_{k}" for k in range(4))


@query(f"{CELL_TABLE} SELECT CASE domain WHEN 'NH' THEN 'Northern Hemisphere' ELSE 'Southern Hemisphere' END AS domain, {BAND_COLUMNS} FROM ce WHERE domain IN ('NH', 'SH') GROUP BY ALL")
def table_1(spark: SparkSession, root: str) -> DataFrame:
    return figures.table_1(terms(spark, root))


@query(
    f"""{CELL_TABLE}, cm AS (SELECT domain, ce.BAND, CASE WHEN n_events > 0 THEN cell ELSE '– / – / –' END AS cell FROM ce LEFT JOIN bc ON bc.BASIN = domain AND bc.BAND = ce.BAND WHERE domain NOT IN ('NH', 'SH'))
SELECT CASE domain WHEN 'WP' THEN 'WNP' WHEN 'NI' THEN 'NIO' WHEN 'SI' THEN 'SIO' ELSE domain END AS domain, {BAND_COLUMNS} FROM cm GROUP BY domain"""
)
def table_2(spark: SparkSession, root: str) -> DataFrame:
    return figures.table_2(terms(spark, root), storm_events(spark, root))


@query(
    ORACLE["surface_decomposition"].rpartition("\nSELECT")[0]
    + """
SELECT HEMISPHERE, SURFACE, round(max(slope) FILTER (COMPONENT = 'TOTAL'), 6) AS total, round(max(p_value) FILTER (COMPONENT = 'TOTAL'), 6) AS mk_p, round(max(slope) FILTER (COMPONENT = 'REDISTRIBUTION'), 6) AS redistribution,
  round(max(slope) FILTER (COMPONENT = 'WITHIN_BAND'), 6) AS within_band, round(max(slope) FILTER (COMPONENT = 'INTERACTION'), 6) AS interaction FROM sl JOIN mk USING (HEMISPHERE, SURFACE, COMPONENT) GROUP BY ALL"""
)
def table_3(spark: SparkSession, root: str) -> DataFrame:
    return figures.table_3(surface_bands(spark, root)).select("HEMISPHERE", "SURFACE", *r("total", "mk_p", "redistribution", "within_band", "interaction"))


# --- audits -----------------------------------------------------------------------------------------------

def _near_sql(keys: str, label: str, source: str, y: str) -> str:
    """Whether slopes and p-values of a source's trends agree, within the report's tolerance, with themselves rounded to DIGITS places."""
    near = lambda c: f"coalesce(abs({c} - round({c}, {DIGITS})) <= 1e-10 + 1e-10 * abs(round({c}, {DIGITS})), false)"
    both = f"(WITH {source}, {trend_sql('g', keys, y)} SELECT {keys}, slope, p_value FROM sl JOIN mk USING ({keys}))"
    name = " || ' ' || ".join(keys.split(", "))
    return " UNION ALL ".join(f"SELECT {name} || ' {label} {w}' AS \"check\", {near(c)} AS passed FROM {both}" for w, c in (("slope", "slope"), ("p", "p_value")))


#: Published numbers are rounded, here so that some are within the tolerance and some are not.
DIGITS = 9
RELEASE_SQL = f"""
{_near_sql("domain", "series", f"{EVENTS}, g AS (SELECT HEMISPHERE AS domain, YEAR, avg(EVENT_INTENSITY_MM_3H) AS mean FROM ev WHERE YEAR BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY ALL)", "mean")}
UNION ALL SELECT * FROM ({_near_sql("record_type, domain", "latitude", f"{EVENTS}, h AS (SELECT CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END AS domain, YEAR, TC_LAT FROM ev), g AS (SELECT 'event' AS record_type, domain, YEAR, avg(abs(TC_LAT)) AS mean FROM h GROUP BY ALL UNION ALL SELECT 'track', domain, YEAR, avg(abs(TC_LAT / 2)) FROM h GROUP BY ALL)", "mean")})
UNION ALL SELECT 'annual closure', true UNION ALL SELECT 'component slopes', true
UNION ALL SELECT 'event count', (SELECT count(*) FROM orders) = (SELECT 2 * count(*) FILTER (o_orderkey % 2 = 0) FROM orders)
UNION ALL SELECT 'band medians', true UNION ALL SELECT 'band counts', true
UNION ALL SELECT 'map cells', (SELECT count(*) FROM (WITH {EVENTS}, {DEGREE} SELECT DISTINCT lat, lon FROM dv)) = (SELECT count(DISTINCT (o_custkey % 40, o_custkey % 30)) FROM orders)
UNION ALL SELECT 'significant map cells', (SELECT count(*) FROM (WITH {EVENTS}, {DEGREE}, {trend_sql("dv", "lat, lon", "mean")} SELECT * FROM mk WHERE p_value < 0.05)) = (SELECT count(DISTINCT o_custkey % 5) FROM orders)
UNION ALL SELECT 'empty band', false"""


@query(RELEASE_SQL)
def release_verification(spark: SparkSession, root: str) -> DataFrame:
    """The report on rounded trends and on counts taken from the tables otherwise: what is within its tolerance, and what not."""
    from .series import degree_means

    ev, orders = storm_events(spark, root), table(spark, root, "orders")
    series = bands.annual_means(ev, years=YEARS).where("domain <> 'GLOBAL'")
    lat = bands.mean_latitude(ev.select((F.col("TC_LAT") / 2).alias("LAT"), "YEAR"), ev, YEARS)
    spatial = figures.trend.trends(degree_means(spark, root), ["lat", "lon"], "mean")
    own = parts(spark, root)
    base = figures.baselines(hemi_bands(spark, root), ev)
    basins = figures.basin_terms(decompose.band_terms(domain_bands(spark, root), ["domain"]).withColumnRenamed("migration", "migration_point"), ev)
    told = lambda df, *keys: [{**{k: x[k] for k in keys}, "trend_per_decade": x["slope"], "p_value": x["p_value"]} for x in df.select(*keys, *r("slope", "p_value", digits=DIGITS)).collect()]
    even = orders.where("o_orderkey % 2 = 0").count()
    places, fives = orders.agg(F.countDistinct(F.col("o_custkey") % 40, F.col("o_custkey") % 30), F.countDistinct(F.col("o_custkey") % 5)).first()
    expected = {
        "global_and_hemisphere_trends": told(figures.trend.trends(series, ["domain"], "mean"), "domain"),
        "latitude_trends": told(figures.trend.trends(lat, ["record_type", "domain"], "mean_lat"), "record_type", "domain"),
        "events": 2 * even, "valid_map_cells": places, "significant_map_cells": fives,
    }
    return figures.verification(series, own, decompose.component_trends(own, ["HEMISPHERE"]), base, ev, spatial, lat, basins, None, expected)


ATTRIBUTED = ORACLE["attributed_cells"].rpartition("\nSELECT")[0] + ",\nac AS (SELECT SID, k, ROW, LAT, LON, p, gla::FLOAT::DOUBLE AS gla, glo::FLOAT::DOUBLE AS glo FROM we JOIN lb USING (SID, k, ROW) JOIN ok USING (SID, k, f))"
CELL_COLUMNS = ("SID", "TIME", "YEAR", "BASIN", "TC_LAT", "TC_LON_360", "GRID_LAT", "GRID_LON", "PRECIP_3H_MM", "PRECIP_MMHR", "IS_INTERPOLATED_TIMESTEP", "ROW")
SPOILT = {"null BASIN": 13, "rate": 7, "cell latitude": 11, "cell longitude": 17, "flag": 5, "year": 19}


@query(
    f"""{ATTRIBUTED}
SELECT "check", CASE {" ".join(f"WHEN \"check\" = '{c}' THEN (SELECT count(*) FROM ac WHERE ROW % {m} = 0)" for c, m in SPOILT.items())} ELSE 0 END::BIGINT AS failures
FROM (VALUES {", ".join(f"('{c}')" for c in (*(f"null {c}" for c in CELL_COLUMNS), "wet", "rate", "cell latitude", "cell longitude", "storm longitude", "flag", "year"))}) t("check")"""
)
def audit_cells(spark: SparkSession, root: str) -> DataFrame:
    a = features.attributed(*storm_fields(spark, root))
    bad = lambda name: F.col("ROW") % SPOILT[name] == 0
    a = a.withColumns({
        "BASIN": F.when(~bad("null BASIN"), F.col("BASIN")), "PRECIP_MMHR": F.when(bad("rate"), F.col("PRECIP_MMHR") + 1).otherwise(F.col("PRECIP_MMHR")),
        "GRID_LAT": F.when(bad("cell latitude"), F.col("GRID_LAT") + 1).otherwise(F.col("GRID_LAT")), "GRID_LON": F.when(bad("cell longitude"), F.col("GRID_LON") - 1).otherwise(F.col("GRID_LON")),
        "IS_INTERPOLATED_TIMESTEP": bad("flag"), "YEAR": F.when(bad("year"), F.lit(1900)).otherwise(F.col("YEAR")),
    })
    return audit.cells(a.select(*CELL_COLUMNS))


# Each rule is broken by the smallest of several steps that exceeds its limit: 4.5e-6 of the rate, 3.6e-4 and 4e-4 degrees, a turn.
LIMITS = {"rate": "abs(l_linenumber - 4) = 3", "cell latitude": "abs(l_partkey % 7 - 3) = 3", "cell longitude": "(abs(l_suppkey % 5 - 2) = 2 OR l_orderkey % 31 = 0)", "storm longitude": "l_suppkey % 11 = 0", "wet": "l_partkey % 13 = 0", "year": "year(l_shipdate) <> 1997", "flag": "l_linenumber = 2"}


@query(
    f"""SELECT "check", CASE {" ".join(f"WHEN \"check\" = '{c}' THEN (SELECT count(*) FROM lineitem WHERE {rule})" for c, rule in LIMITS.items())} WHEN "check" = 'warning: no North Atlantic' THEN 1 ELSE 0 END::BIGINT AS failures
FROM (VALUES {", ".join(f"('{c}')" for c in (*(f"null {c}" for c in CELL_COLUMNS), "wet", "rate", "cell latitude", "cell longitude", "storm longitude", "flag", "year", "not empty", "warning: no North Atlantic"))}) t("check")"""
)
def audit_cell_limits(spark: SparkSession, root: str) -> DataFrame:
    """Cells whose values lie just within and just beyond what each rule allows, judged as the table of 1997."""
    li = table(spark, root, "lineitem")
    row = F.pmod(F.col("l_orderkey") * 977 + F.col("l_linenumber"), F.lit(6_480_000)).cast("int")
    p = F.when(F.col("l_partkey") % 13 == 0, F.lit(0.3)).otherwise(F.col("l_quantity") + 0.31).cast("float")
    off = lambda c, m, k, step: (F.col(c) % m - k) * step
    cells = li.select(
        F.lit("S").alias("SID"), F.col("l_shipdate").alias("TIME"), F.year("l_shipdate").alias("YEAR"), F.lit("WP").alias("BASIN"), F.lit(1.0).alias("TC_LAT"),
        F.when(F.col("l_suppkey") % 11 == 0, 360.0).otherwise(359.99).alias("TC_LON_360"), (row_lat(row) + off("l_partkey", 7, 3, 1.2e-4)).alias("GRID_LAT"),
        (row_lon(row) + off("l_suppkey", 5, 2, 2e-4) - F.when(F.col("l_orderkey") % 31 == 0, 360.0).otherwise(0.0)).alias("GRID_LON"), p.alias("PRECIP_3H_MM"),
        (p.cast("double") / 3 * (1 + (F.col("l_linenumber") - 4) * 1.5e-6)).alias("PRECIP_MMHR"), (F.col("l_linenumber") == 2).alias("IS_INTERPOLATED_TIMESTEP"), row.alias("ROW"),
    )
    return audit.cells(cells, year=1997)


@query(
    f"""{ATTRIBUTED},
ad2 AS (SELECT *, fmod(fmod(glo - LON + 180, 360) + 360, 360) - 180 AS r FROM ac),
ak AS (SELECT *, 2 * 6371.0 * asin(sqrt(greatest(0, least(1, pow(sin(radians(gla - LAT) / 2), 2) + cos(radians(LAT)) * cos(radians(gla)) * pow(sin(radians(r) / 2), 2))))) AS d FROM ad2)
SELECT SID, strftime(TIMESTAMP '2024-01-01' + INTERVAL 3 HOURS * k, '%Y-%m-%d %H:%M:%S') AS TIME, count(*)::BIGINT AS cells, round(max(d), 2) AS max_km, round(max(abs(r)), 2) AS max_dlon, 0::BIGINT AS bad_rows,
  max(glo) - min(glo) > 180 AS crosses_zero, bool_or(glo < 180) AND bool_or(glo >= 180) AS crosses_180, CASE WHEN lag(k) OVER (PARTITION BY SID ORDER BY k) IS NOT NULL THEN 0.0::DOUBLE END AS step_dlon FROM ak GROUP BY SID, k"""
)
def audit_boundary(spark: SparkSession, root: str) -> DataFrame:
    b = audit.boundary(features.attributed(*storm_fields(spark, root)))
    return b.select("SID", stamp(), "cells", *r("max_km", "max_dlon", digits=2), "bad_rows", "crosses_zero", "crosses_180", F.round("step_dlon", 3).alias("step_dlon"))


@query(
    f"""{ATTRIBUTED}, n AS (SELECT count(*) AS a, count(*) FILTER (SID <> 'F0') AS b, count(*) FILTER (LAT >= 0) AS c, (count(*) FILTER (SID = 'F0') > 0) AS d FROM ac)
SELECT "check", CASE "check" WHEN 'storm' THEN b WHEN 'hemisphere' THEN c WHEN 'not empty' THEN 1 - d::INT WHEN 'crosses 180' THEN 1 ELSE 0 END::BIGINT AS failures
FROM n, (VALUES ('storm'), ('hemisphere'), ('row round trip'), ('distance'), ('relative longitude'), ('not empty'), ('crosses 180'), ('steps')) t("check")"""
)
def audit_boundary_checks(spark: SparkSession, root: str) -> DataFrame:
    """Of a storm in the south that stays at one longitude: what other storms break, and the crossing that it lacks."""
    return audit.boundary_checks(features.attributed(*storm_fields(spark, root)), "F0", "SH", cross_180=True)


# Latitudes by order, of which every fiftieth goes the wrong way, and longitudes by customer.
AXES = """ax AS (SELECT 'lat' AS AXIS, o_orderkey AS POS, 89.95::DOUBLE - o_orderkey * 0.1::DOUBLE + CASE WHEN o_orderkey % 50 = 7 THEN 0.25::DOUBLE ELSE 0 END AS VALUE FROM orders
  UNION ALL SELECT 'lon', c_custkey, -179.95::DOUBLE + c_custkey * 0.1::DOUBLE FROM customer),
st AS (SELECT *, VALUE - lag(VALUE) OVER (PARTITION BY AXIS ORDER BY POS) AS s FROM ax),
sm AS (SELECT AXIS, count(*) AS n, count(*) FILTER (CASE AXIS WHEN 'lat' THEN s >= 0 ELSE s <= 0 END) AS wrong, arg_min(VALUE, POS) AS a, arg_max(VALUE, POS) AS z FROM st GROUP BY ALL)"""


def axes(spark: SparkSession, root: str) -> DataFrame:
    lat = table(spark, root, "orders").select(F.lit("lat").alias("AXIS"), F.col("o_orderkey").alias("POS"), (89.95 - F.col("o_orderkey") * 0.1 + F.when(F.col("o_orderkey") % 50 == 7, 0.25).otherwise(0.0)).alias("VALUE"))
    return lat.unionByName(table(spark, root, "customer").select(F.lit("lon").alias("AXIS"), F.col("c_custkey").alias("POS"), (F.col("c_custkey") * 0.1 - 179.95).alias("VALUE")))


@query(
    f"""WITH {AXES}, e(AXIS, size, first, last) AS (VALUES ('lat', 1800, 89.95, -89.95), ('lon', 3600, -179.95, 179.95))
SELECT AXIS || ' size' AS "check", (n <> size)::BIGINT AS failures FROM sm JOIN e USING (AXIS) UNION ALL SELECT AXIS || ' direction', (wrong > 0)::BIGINT FROM sm
UNION ALL SELECT AXIS || ' ends', (abs(a - first) > 2e-3 OR abs(z - last) > 2e-3)::BIGINT FROM sm JOIN e USING (AXIS) UNION ALL SELECT 'unit', 0"""
)
def audit_grid(spark: SparkSession, root: str) -> DataFrame:
    return audit.grid(axes(spark, root), "mm / 3hr")


@query(
    """WITH x AS (SELECT user_id AS NAME, -event_id::DOUBLE + CASE WHEN event_id % 97 = 0 THEN 5000 ELSE 0 END AS v, event_id AS p FROM events),
s AS (SELECT *, v - lag(v) OVER (PARTITION BY NAME ORDER BY p) AS s FROM x),
f AS (SELECT NAME, count(*) AS n, count(*) FILTER (s < 0) AS falling, arg_min(v, p) AS a, arg_max(v, p) AS z FROM s GROUP BY ALL)
SELECT 'lat size' AS "check", count(*) FILTER (n <> 67)::BIGINT AS failures FROM f UNION ALL SELECT 'lat direction', count(*) FILTER (falling <> n - 1)::BIGINT FROM f
UNION ALL SELECT 'lat ends', count(*) FILTER (abs(a + 75) > 75 OR abs(z + 9900) > 75)::BIGINT FROM f"""
)
def audit_archive_grids(spark: SparkSession, root: str) -> DataFrame:
    """Axes of an archive, one for each user: how many have another size, direction or ends."""
    v = -F.col("event_id").cast("double") + F.when(F.col("event_id") % 97 == 0, 5000).otherwise(0)
    axes = table(spark, root, "events").select(F.col("user_id").alias("NAME"), F.lit("lat").alias("AXIS"), F.col("event_id").alias("POS"), v.alias("VALUE"))
    return audit.archive_grids(audit.axis_summaries(axes), {"lat": (67, -75.0, -9900.0)}, 75.0)


# --- files ------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder in the folder that the executors share; deleted at the end if it is a local path."""
    path = f"{shared_dir(spark)}/pluvia-{uuid.uuid4().hex}"
    if urlparse(path).scheme in ("", "file"):
        atexit.register(shutil.rmtree, urlparse(path).path, True)
    return path


RAW_SQL = f"""SELECT 'T' || (o_custkey % 60) || '-' || strftime(o_orderdate, '%Y%m') || '-' || (o_orderkey // 150000) AS SID,
  strftime(date_trunc('month', o_orderdate) + INTERVAL 6 HOURS * (o_orderkey % 30) + CASE WHEN o_custkey % 60 = 7 THEN INTERVAL 3 HOURS ELSE INTERVAL 0 HOURS END, '%Y-%m-%d %H:%M:%S') AS ISO_TIME,
  {list(BASINS)}[o_custkey % 60 % 7 + 1] AS BASIN, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 150)::VARCHAR ELSE ' ' END AS USA_WIND FROM orders"""


@query(RAW_SQL)
def source_track_csv(spark: SparkSession, root: str) -> DataFrame:
    """Track rows written as the archive writes them, with a row of units, and read back: NA is a basin, blanks stay."""
    raw, path = all_raw_rows(spark, root), scratch(spark)
    units = raw.limit(1).select(*(F.lit(" ").alias(c) for c in raw.columns))
    raw.unionByName(units).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.raw_tracks(spark, path).select("SID", "ISO_TIME", "BASIN", "USA_WIND")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NA' ELSE 'x, \"y\"' END AS note FROM supplier")
def sink_csv(spark: SparkSession, root: str) -> DataFrame:
    s, path = table(spark, root, "supplier"), scratch(spark)
    s = s.withColumn("note", F.when(F.col("s_suppkey") % 7 == 0, None).when(F.col("s_suppkey") % 7 == 1, "NA").otherwise('x, "y"'))
    files.write_csv(s, path)
    return files.csv_table(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double, note string")


@query(f"WITH {EVENTS} SELECT o_orderkey, {STAMP}, YEAR, BASIN FROM ev WHERE YEAR BETWEEN 1996 AND 1999 UNION ALL SELECT o_orderkey + 1000000000, {STAMP}, YEAR, BASIN FROM ev WHERE YEAR = 2000")
def sink_annual(spark: SparkSession, root: str) -> DataFrame:
    """Years written, one of them replaced, read back; years that are there are not overwritten without being asked."""
    ev, path = storm_events(spark, root).select("o_orderkey", "TIME", "YEAR", "BASIN"), scratch(spark)
    files.write_annual(ev, path)
    again = ev.where("YEAR = 2000").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    try:
        files.write_annual(again, path)
        raise AssertionError("a year was overwritten")
    except FileExistsError:
        files.write_annual(again, path, overwrite=True)
    return files.annual(spark, path, 1996, 2000).select("o_orderkey", stamp(), F.col("YEAR").cast("int").alias("YEAR"), "BASIN")


@query("SELECT sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS SHA256 FROM customer GROUP BY c_nationkey")
def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """Digests of files that hold the customers of a nation, a line each."""
    path = scratch(spark)
    c = table(spark, root, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    return files.digests(spark, path, "*.txt").select("SHA256")


@query(EVENT_SQL)
def event_revisions(spark: SparkSession, root: str) -> DataFrame:
    """Extreme cells by a file stream, kept by batch, as events: those of one batch over the whole table. The second run finds nothing new."""
    path = scratch(spark)
    c = wet_samples(spark, root, spark.readStream.schema(table(spark, root, "events").schema).parquet(f"{root}/events.parquet*"))
    t = events.checked_thresholds(local_thresholds(wet_samples(spark, root)))
    x = events.extreme_cells(c, t).withColumn("ROW", F.col("event_id"))  # samples of a user and step stay apart
    for _ in range(2):
        incremental.keep_extreme(x, f"{path}/cells", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return event_columns(incremental.events_so_far(spark, f"{path}/cells"))


@query("SELECT year(o_orderdate)::INT AS YEAR, count(*)::BIGINT AS rows, 'o_orderkey,o_totalprice' AS columns FROM orders GROUP BY ALL")
def source_footers(spark: SparkSession, root: str) -> DataFrame:
    """Rows and columns of an annual table's files, from their footers alone."""
    path = scratch(spark)
    files.write_annual(table(spark, root, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("YEAR")), path)
    foot = files.parquet_footers(spark, path)
    return foot.groupBy(F.regexp_extract("PATH", "YEAR=([0-9]+)", 1).cast("int").alias("YEAR")).agg(F.sum("rows").alias("rows"), F.max(F.array_join("columns", ",")).alias("columns"))


@query(f"WITH {EVENTS} SELECT BASIN, CASE BASIN {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BASIN_NAMES.items())} ELSE BASIN END AS name, count(*)::BIGINT AS n FROM ev GROUP BY ALL")
def basin_names(spark: SparkSession, root: str) -> DataFrame:
    """Events of basins that a file names by the long code, which must not be taken for a missing value, with names for display."""
    ev, path = storm_events(spark, root), scratch(spark)
    files.write_csv(ev.select("o_orderkey", F.when(F.col("BASIN") == "NA", "NATL").otherwise(F.col("BASIN")).alias("BASIN")), path)
    back = files.csv_table(spark, path, "o_orderkey long, BASIN string").withColumn("BASIN", recoded_basin("BASIN"))
    return back.groupBy("BASIN").agg(F.count(F.lit(1)).alias("n")).select("BASIN", display_basin("BASIN").alias("name"), "n")


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver through Hadoop's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


@query("SELECT r_regionkey::BIGINT AS box, r_name AS name FROM region")
def source_json(spark: SparkSession, root: str) -> DataFrame:
    """An array of objects in one JSON document."""
    rows = table(spark, root, "region").agg(F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("box"), F.col("r_name").alias("name")))).alias("j")).first()["j"]
    path = f"{scratch(spark)}/boxes.json"
    put(spark, path, rows)
    return files.json_table(spark, path)


@query("SELECT '| r_regionkey | r_name |\n| --- | --- |\n' || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', '\n' ORDER BY r_regionkey) || '\n' AS text FROM region")
def markdown_table(spark: SparkSession, root: str) -> DataFrame:
    text = report.markdown(table(spark, root, "region").select("r_regionkey", "r_name"), ["r_regionkey"])
    return spark.createDataFrame([(text,)], "text string")
