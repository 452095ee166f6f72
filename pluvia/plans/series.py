"""Queries: band tables, decompositions, trends, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, bootstrap, decompose, dist, report, trend
from ..sources.tables import table
from .base import BAND_TABLE, COMPONENTS, EVENTS, LONG_COMPONENTS, YEARS, band_sql, query, storm_events, trend_sql

#: The bootstrap's own replicates.
HOW = {"block": bootstrap.BLOCK_YEARS, "repetitions": bootstrap.REPETITIONS, "seed": bootstrap.SEED}


def r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def hemi_bands(spark: SparkSession, root: str) -> DataFrame:
    return bands.annual_bands(storm_events(spark, root), ["HEMISPHERE"], YEARS)


def parts(spark: SparkSession, root: str) -> DataFrame:
    return decompose.components(hemi_bands(spark, root), ["HEMISPHERE"])


@query(
    f"""WITH {BAND_TABLE}
SELECT HEMISPHERE, YEAR, BAND, n AS N_EVENTS, round(v, 6) AS INTENSITY_SUM, round(v / nullif(n, 0), 6) AS MEAN_INTENSITY,
       round(n / nullif(sum(n) OVER (PARTITION BY HEMISPHERE, YEAR), 0), 6) AS RELATIVE_FREQUENCY,
       CASE WHEN HEMISPHERE = 'NH' THEN ['0-15', '15-25', '25-35', '35-90'][BAND + 1] ELSE ['0-10', '10-15', '15-20', '20-90'][BAND + 1] END AS BAND_LABEL
FROM ab"""
)
def annual_band_table(spark: SparkSession, root: str) -> DataFrame:
    return bands.labelled(hemi_bands(spark, root)).select("HEMISPHERE", "YEAR", "BAND", "N_EVENTS", *r("INTENSITY_SUM", "MEAN_INTENSITY", "RELATIVE_FREQUENCY"), "BAND_LABEL")


@query(f"WITH {COMPONENTS} SELECT HEMISPHERE, YEAR, {', '.join(f'round({c}, 6) AS {c}' for c in decompose.COMPONENTS)}, true AS closes FROM co")
def decomposition_components(spark: SparkSession, root: str) -> DataFrame:
    return parts(spark, root).select("HEMISPHERE", "YEAR", *r(*decompose.COMPONENTS), (F.abs("CLOSURE_ERROR") <= 1e-10).alias("closes"))


@query(
    f"""WITH {LONG_COMPONENTS}, {trend_sql("lc", "HEMISPHERE, COMPONENT", "value")}
SELECT HEMISPHERE, COMPONENT, round(slope, 6) AS slope, round(p_value, 6) AS p_value, n FROM sl JOIN mk USING (HEMISPHERE, COMPONENT)"""
)
def component_trends(spark: SparkSession, root: str) -> DataFrame:
    return decompose.component_trends(parts(spark, root), ["HEMISPHERE"]).select("HEMISPHERE", "COMPONENT", *r("slope", "p_value"), "n")


MONTHLY = f"{EVENTS}, mo AS (SELECT BASIN, year(TIME) * 12 + month(TIME) AS t, avg(EVENT_INTENSITY_MM_3H) AS y FROM ev GROUP BY ALL)"


def monthly(spark: SparkSession, root: str) -> DataFrame:
    return storm_events(spark, root).groupBy("BASIN", (F.year("TIME") * 12 + F.month("TIME")).cast("long").alias("t")).agg(F.avg("EVENT_INTENSITY_MM_3H").alias("y"))


@query(f"WITH {MONTHLY}, {trend_sql('mo', 'BASIN', 'y', 't', '120')} SELECT BASIN, round(slope, 6) AS slope FROM sl")
def theil_sen_by_domain(spark: SparkSession, root: str) -> DataFrame:
    return trend.theil_sen(monthly(spark, root), ["BASIN"], "y", "t", 120).select("BASIN", *r("slope"))


@query(f"WITH {MONTHLY}, {trend_sql('mo', 'BASIN', 'y', 't', '120')} SELECT BASIN, round(slope, 6) AS slope FROM sl")
def theil_sen_long_series(spark: SparkSession, root: str) -> DataFrame:
    return trend.theil_sen(monthly(spark, root), ["BASIN"], "y", "t", 120).select("BASIN", *r("slope"))


# A point a day: some 2,500 in each series, three million pairs.
DAILY = "da AS (SELECT l_returnflag AS k, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS t, avg(l_extendedprice) AS y, (sum(l_partkey) % 40)::DOUBLE AS tied FROM lineitem GROUP BY ALL)"


def daily(spark: SparkSession, root: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("k"), day.alias("t")).agg(F.avg("l_extendedprice").alias("y"), (F.sum("l_partkey") % 40).cast("double").alias("tied"))


@query(f"WITH {DAILY}, {trend_sql('da', 'k', 'y', 't', '3652.5')} SELECT k, n, s, round(slope, 6) AS slope, round(p_value, 6) AS p_value FROM sl JOIN mk USING (k)")
def daily_trends(spark: SparkSession, root: str) -> DataFrame:
    """Slope by decade and test of daily means."""
    d = daily(spark, root)
    test = trend.mann_kendall(d, ["k"], "y", "t", full=True)
    return trend.theil_sen(d, ["k"], "y", "t", 3652.5).join(test, "k").select("k", "n", "s", *r("slope", "p_value"))


@query(f"WITH {DAILY}, {trend_sql('da', 'k', 'tied', 't', '1')} SELECT k, n, s, round(var, 4) AS var, round(slope, 9) AS slope, round(p_value, 6) AS p_value FROM sl JOIN mk USING (k)")
def daily_trends_with_ties(spark: SparkSession, root: str) -> DataFrame:
    """As before, where values and slopes repeat."""
    d = daily(spark, root)
    test = trend.mann_kendall(d, ["k"], "tied", "t", full=True)
    return trend.theil_sen(d, ["k"], "tied", "t", 1.0).join(test, "k").select("k", "n", "s", *r("var", digits=4), *r("slope", digits=9), *r("p_value"))


@query(f"WITH {MONTHLY}, {trend_sql('mo', 'BASIN', 'y', 't', '1')} SELECT BASIN, n, s, round(var, 6) AS var, round(z, 6) AS z, round(p_value, 6) AS p_value FROM mk")
def mann_kendall(spark: SparkSession, root: str) -> DataFrame:
    return trend.mann_kendall(monthly(spark, root), ["BASIN"], "y", "t", full=True).select("BASIN", "n", "s", *r("var", "z", "p_value"))


# A remainder of sums has ties at every size.
TIED = "td AS (SELECT l_returnflag AS k, l_linenumber * 100 + l_quantity::INT AS t, (sum(l_partkey) % 5)::DOUBLE AS y FROM lineitem GROUP BY ALL)"


@query(f"WITH {TIED}, {trend_sql('td', 'k', 'y', 't', '1')} SELECT k, n, s, round(var, 6) AS var, round(p_value, 6) AS p_value FROM mk")
def mann_kendall_ties(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("k"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("t")).agg((F.sum("l_partkey") % 5).cast("double").alias("y"))
    return trend.mann_kendall(t, ["k"], "y", "t", full=True).select("k", "n", "s", *r("var", "p_value"))


@query(
    f"""WITH {MONTHLY}, {trend_sql("mo", "BASIN", "y", "t", "1")},
li AS (SELECT BASIN, any_value(slope) AS slope, quantile_cont(y - slope * t, 0.5) AS intercept FROM mo JOIN sl USING (BASIN) GROUP BY BASIN)
SELECT mo.BASIN, mo.t, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(intercept + slope * mo.t, 4) AS fit FROM mo JOIN li USING (BASIN)"""
)
def sen_line_joint(spark: SparkSession, root: str) -> DataFrame:
    return trend.sen_line(monthly(spark, root), ["BASIN"], "y", "t").select("BASIN", "t", *r("slope"), *r("intercept", "fit", digits=4))


@query(
    f"""WITH {MONTHLY}, {trend_sql("mo", "BASIN", "y", "t", "1")},
li AS (SELECT BASIN, any_value(slope) AS slope, quantile_cont(y, 0.5) - any_value(slope) * quantile_cont(t, 0.5) AS intercept FROM mo JOIN sl USING (BASIN) GROUP BY BASIN)
SELECT mo.BASIN, mo.t, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(intercept + slope * mo.t, 4) AS fit FROM mo JOIN li USING (BASIN)"""
)
def sen_line_separate(spark: SparkSession, root: str) -> DataFrame:
    return trend.sen_line(monthly(spark, root), ["BASIN"], "y", "t", joint=False).select("BASIN", "t", *r("slope"), *r("intercept", "fit", digits=4))


DOMAINS = f"""{EVENTS},
dm AS (SELECT *, HEMISPHERE AS domain, HEMISPHERE AS dh FROM ev UNION ALL
       SELECT *, BASIN AS domain, CASE WHEN BASIN IN ('SI', 'SP') THEN 'SH' ELSE 'NH' END AS dh FROM ev WHERE BASIN <> 'SA'),
ds AS (SELECT domain, YEAR, {band_sql("TC_LAT", "dh")} AS BAND, count(*)::BIGINT AS n, sum(EVENT_INTENSITY_MM_3H) AS v FROM dm GROUP BY ALL),
dg AS (SELECT domain, y::INT AS YEAR, b::INT AS BAND FROM (SELECT DISTINCT domain FROM dm), generate_series(1995, 2001) t(y), generate_series(0, 3) u(b)),
db AS (SELECT domain, YEAR, BAND, coalesce(n, 0)::BIGINT AS n, coalesce(v, 0.0) AS v FROM dg LEFT JOIN ds USING (domain, YEAR, BAND)),
dt AS (SELECT domain, YEAR, BAND, coalesce(n / nullif(sum(n) OVER w, 0), 0) AS share, v / nullif(n, 0) AS mean, coalesce(v / nullif(sum(n) OVER w, 0), 0) AS part FROM db WINDOW w AS (PARTITION BY domain, YEAR)),
dk AS (SELECT domain, BAND, YEAR, 'share' AS kind, share AS value FROM dt UNION ALL SELECT domain, BAND, YEAR, 'mean', mean FROM dt UNION ALL SELECT domain, BAND, YEAR, 'part', part FROM dt)"""


def domain_bands(spark: SparkSession, root: str) -> DataFrame:
    ev = bands.basin_domains(storm_events(spark, root))
    return bands.annual_bands(ev, ["domain"], YEARS, hemi="domain_hemisphere", strict=False)


@query(
    f"""WITH {DOMAINS}, {trend_sql("dk", "domain, BAND, kind", "value")},
s AS (SELECT domain, BAND, coalesce(max(slope) FILTER (kind = 'share'), 0) AS ss, coalesce(max(slope) FILTER (kind = 'mean'), 0) AS sm, coalesce(max(slope) FILTER (kind = 'part'), 0) AS sp FROM sl GROUP BY ALL),
m AS (SELECT domain, BAND, avg(share) AS share, coalesce(avg(mean), 0) AS mean FROM dt GROUP BY ALL)
SELECT domain, BAND, round(ss * mean, 6) AS migration, round(share * sm, 6) AS intensity, round(sp - ss * mean - share * sm, 6) AS residual, round(sp, 6) AS total FROM s JOIN m USING (domain, BAND)"""
)
def band_decomposition(spark: SparkSession, root: str) -> DataFrame:
    return decompose.band_terms(domain_bands(spark, root), ["domain"]).select("domain", "BAND", *r("migration", "intensity", "residual", "total"))


@query(
    f"""WITH {DOMAINS}, sr AS (SELECT domain, YEAR, sum(n)::BIGINT AS N_t, coalesce(sum(v) / nullif(sum(n), 0), 0) AS mean FROM db GROUP BY ALL), {trend_sql("sr", "domain", "mean")}
SELECT domain, YEAR, N_t, round(mean, 6) AS mean, round(slope, 6) AS slope, round(p_value, 6) AS p_value FROM sr JOIN sl USING (domain) JOIN mk USING (domain)"""
)
def domain_annual_series(spark: SparkSession, root: str) -> DataFrame:
    s = decompose.annual_series(domain_bands(spark, root), ["domain"])
    return s.join(trend.trends(s, ["domain"], "mean"), "domain").select("domain", "YEAR", "N_t", *r("mean", "slope", "p_value"))


@query(
    f"""WITH {EVENTS}, g AS (SELECT coalesce(HEMISPHERE, 'GLOBAL') AS domain, YEAR, count(*)::BIGINT AS n, avg(EVENT_INTENSITY_MM_3H) AS mean FROM ev GROUP BY GROUPING SETS ((YEAR), (HEMISPHERE, YEAR))),
grid AS (SELECT DISTINCT domain, y::INT AS YEAR FROM g, generate_series(1994, 2002) t(y))
SELECT domain, YEAR, coalesce(n, 0)::BIGINT AS n, round(mean, 6) AS mean FROM grid LEFT JOIN g USING (domain, YEAR)"""
)
def global_and_domain_annual(spark: SparkSession, root: str) -> DataFrame:
    return bands.annual_means(storm_events(spark, root), years=(1994, 2002)).select("domain", "YEAR", "n", *r("mean"))


@query(
    f"""WITH {EVENTS}, lt AS (SELECT 'event' AS record_type, CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END AS domain, YEAR, abs(TC_LAT) AS l FROM ev UNION ALL
  SELECT 'track', CASE WHEN TC_LAT / 2 >= 0 THEN 'NH' ELSE 'SH' END, YEAR, abs(TC_LAT / 2) FROM ev WHERE o_orderkey % 2 = 0),
g AS (SELECT record_type, domain, YEAR, avg(l) AS mean_lat, count(*)::BIGINT AS n_records FROM lt GROUP BY ALL),
grid AS (SELECT DISTINCT record_type, domain, y::INT AS YEAR FROM g, generate_series(1994, 2002) t(y))
SELECT record_type, domain, YEAR, round(mean_lat, 6) AS mean_lat, n_records FROM grid LEFT JOIN g USING (record_type, domain, YEAR)"""
)
def mean_latitude(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root)
    tracks = ev.where("o_orderkey % 2 = 0").select((F.col("TC_LAT") / 2).alias("LAT"), "YEAR")
    return bands.mean_latitude(tracks, ev, (1994, 2002)).select("record_type", "domain", "YEAR", *r("mean_lat"), "n_records")


OWN = "(CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END)"
COUNTS = f"bc AS (SELECT BASIN, {band_sql('TC_LAT', OWN)} AS BAND, count(*)::BIGINT AS n_events FROM ev GROUP BY ALL)"


@query(f"WITH {EVENTS}, {COUNTS} SELECT * FROM bc")
def basin_band_counts(spark: SparkSession, root: str) -> DataFrame:
    return bands.basin_band_counts(storm_events(spark, root))


@query(
    f"""WITH {EVENTS}, {COUNTS}, g AS (SELECT BASIN, b::INT AS BAND, 1.5::DOUBLE AS estimate FROM (SELECT DISTINCT BASIN FROM ev), generate_series(0, 5) t(b))
SELECT BASIN, BAND, CASE WHEN coalesce(n_events, 0) > 0 THEN estimate END AS estimate, coalesce(n_events, 0)::BIGINT AS n_events FROM g LEFT JOIN bc USING (BASIN, BAND)"""
)
def masked_estimates(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root)
    grid = ev.select("BASIN").distinct().select("BASIN", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("BAND"), F.lit(1.5).alias("estimate"))
    return decompose.masked(grid, bands.basin_band_counts(ev), ["BASIN", "BAND"], ["estimate"])


SURFACE = f"""su AS (SELECT CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END AS HEMISPHERE, CASE WHEN o_orderkey % 50 < 15 THEN 'land' ELSE 'ocean' END AS SURFACE, YEAR, TC_LAT, EVENT_INTENSITY_MM_3H FROM ev),
ss AS (SELECT HEMISPHERE, SURFACE, YEAR, {band_sql("TC_LAT", "HEMISPHERE")} AS BAND, count(*)::BIGINT AS n_j, sum(EVENT_INTENSITY_MM_3H) AS vol_j FROM su GROUP BY ALL),
sg AS (SELECT HEMISPHERE, SURFACE, y::INT AS YEAR, b::INT AS BAND FROM (SELECT DISTINCT HEMISPHERE, SURFACE FROM ss), generate_series(1995, 2001) t(y), generate_series(0, 3) u(b)),
sb AS (SELECT HEMISPHERE, SURFACE, YEAR, BAND, coalesce(n_j, 0)::BIGINT AS n_j, coalesce(vol_j, 0.0) AS vol_j FROM sg LEFT JOIN ss USING (HEMISPHERE, SURFACE, YEAR, BAND))"""


def surface_bands(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root).withColumn("ROW", F.col("o_orderkey") % 50)
    land = spark.range(15).select(F.col("id").alias("ROW"))
    return bands.surface_bands(bands.with_surface(ev, land), YEARS, "EVENT_INTENSITY_MM_3H")


@query(f"WITH {EVENTS}, {SURFACE} SELECT HEMISPHERE, SURFACE, YEAR, BAND, n_j, round(vol_j, 6) AS vol_j FROM sb")
def surface_band_table(spark: SparkSession, root: str) -> DataFrame:
    return surface_bands(spark, root).select("HEMISPHERE", "SURFACE", "YEAR", "BAND", "n_j", *r("vol_j"))


@query(
    f"""WITH {EVENTS}, {SURFACE},
q0 AS (SELECT *, n_j / nullif(sum(n_j) OVER (PARTITION BY HEMISPHERE, SURFACE, YEAR), 0) AS a, vol_j / nullif(n_j, 0) AS m FROM sb),
q1 AS (SELECT *, avg(coalesce(a, 0)) OVER w AS a0, avg(m) OVER w AS m0 FROM q0 WINDOW w AS (PARTITION BY HEMISPHERE, SURFACE, BAND)),
q2 AS (SELECT HEMISPHERE, SURFACE, YEAR, sum((coalesce(a, 0) - a0) * m0) AS red, sum(a0 * (coalesce(m, m0) - m0)) AS wit, sum(coalesce(a, 0) * coalesce(m, m0)) AS tot, sum((coalesce(a, 0) - a0) * (coalesce(m, m0) - m0)) AS int FROM q1 GROUP BY ALL),
q3 AS (SELECT HEMISPHERE, SURFACE, YEAR, 'TOTAL' AS COMPONENT, tot AS value FROM q2 UNION ALL SELECT HEMISPHERE, SURFACE, YEAR, 'REDISTRIBUTION', red FROM q2
       UNION ALL SELECT HEMISPHERE, SURFACE, YEAR, 'WITHIN_BAND', wit FROM q2 UNION ALL SELECT HEMISPHERE, SURFACE, YEAR, 'INTERACTION', int FROM q2), {trend_sql("q3", "HEMISPHERE, SURFACE, COMPONENT", "value")}
SELECT HEMISPHERE, SURFACE, COMPONENT, round(slope, 6) AS slope, round(p_value, 6) AS p_value, n FROM sl JOIN mk USING (HEMISPHERE, SURFACE, COMPONENT)"""
)
def surface_decomposition(spark: SparkSession, root: str) -> DataFrame:
    p = decompose.components(surface_bands(spark, root), ["HEMISPHERE", "SURFACE"], "n_j", "vol_j", strict=False)
    return decompose.component_trends(p, ["HEMISPHERE", "SURFACE"]).select("HEMISPHERE", "SURFACE", "COMPONENT", *r("slope", "p_value"), "n")


DEGREE = """dc AS (SELECT floor((o_custkey % 40) / 4.0) + 0.5 AS lat, floor(fmod(((o_custkey % 30) / 3.0 - 2)::DOUBLE + 360, 360)) + 0.5 AS lon, YEAR, EVENT_INTENSITY_MM_3H AS v
  FROM ev JOIN orders USING (o_orderkey)),
da AS (SELECT lat, lon, YEAR, avg(v) AS mean FROM dc GROUP BY ALL),
dv AS (SELECT *, count(*) OVER (PARTITION BY lat, lon) AS valid_years FROM da QUALIFY valid_years >= 5)"""


def degree_means(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", ((F.col("o_custkey") % 40) / 4).alias("la"), ((F.col("o_custkey") % 30) / 3 - 2).alias("lo"))
    return bands.degree_cell_means(storm_events(spark, root).join(o, "o_orderkey"), "EVENT_INTENSITY_MM_3H", "la", "lo", 5)


@query(f"WITH {EVENTS}, {DEGREE}, {trend_sql('dv', 'lat, lon', 'mean')} SELECT lat, lon, round(slope, 6) AS trend, round(p_value, 6) AS p_value, n AS valid_years FROM sl JOIN mk USING (lat, lon)")
def degree_cell_trends(spark: SparkSession, root: str) -> DataFrame:
    t = trend.trends(degree_means(spark, root), ["lat", "lon"], "mean")
    return t.select("lat", "lon", F.round("slope", 6).alias("trend"), *r("p_value"), F.col("n").alias("valid_years"))


@query(f"WITH {EVENTS}, {DEGREE}, {trend_sql('dv', 'lat, lon', 'mean')} SELECT lat, round(avg(slope), 6) AS mean, round(stddev_pop(slope), 6) AS std, count(slope)::BIGINT AS n FROM sl GROUP BY lat")
def zonal_profile(spark: SparkSession, root: str) -> DataFrame:
    t = trend.theil_sen(degree_means(spark, root), ["lat", "lon"], "mean", out="trend")
    return dist.zonal_profile(t).select("lat", *r("mean", "std"), "n")


BOXES = "bx(box, name, lon_min, lon_max, lat_min, lat_max) AS (VALUES (1, 'west', -2, 1, 0, 5), (2, 'east', 2, 6, 3, 9))"


@query(
    f"""WITH {EVENTS}, {DEGREE}, {trend_sql("dv", "lat, lon", "mean")}, {BOXES}
SELECT box, name, round(avg(slope), 6) AS mean, count(slope)::BIGINT AS n FROM sl JOIN bx ON fmod(lon + 180, 360) - 180 BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max GROUP BY box, name"""
)
def box_means(spark: SparkSession, root: str) -> DataFrame:
    t = trend.theil_sen(degree_means(spark, root), ["lat", "lon"], "mean", out="trend")
    boxes = spark.createDataFrame([(1, "west", -2, 1, 0, 5), (2, "east", 2, 6, 3, 9)], "box int, name string, lon_min int, lon_max int, lat_min int, lat_max int")
    return dist.box_means(t, boxes).select("box", "name", *r("mean"), "n")


def _draws_sql(n: int) -> str:
    rows = bootstrap.block_draws(n, bootstrap.BLOCK_YEARS, bootstrap.REPETITIONS, bootstrap.SEED)
    return "bi(REP, POS, SRC) AS (VALUES " + ", ".join(f"({k}, {p}, {s})" for k, row in enumerate(rows.tolist()) for p, s in enumerate(row)) + ")"


BOOT = f"""pt0 AS (SELECT HEMISPHERE, COMPONENT, YEAR, row_number() OVER (PARTITION BY HEMISPHERE, COMPONENT ORDER BY YEAR) - 1 AS pos, value AS y FROM lc),
l0 AS (SELECT a.HEMISPHERE, a.COMPONENT, quantile_cont((b.y - a.y) / (b.YEAR - a.YEAR), 0.5) AS slope FROM pt0 a JOIN pt0 b ON a.HEMISPHERE = b.HEMISPHERE AND a.COMPONENT = b.COMPONENT AND a.YEAR < b.YEAR GROUP BY ALL),
l1 AS (SELECT HEMISPHERE, COMPONENT, any_value(slope) AS slope, quantile_cont(y, 0.5) - any_value(slope) * quantile_cont(YEAR, 0.5) AS ic FROM pt0 JOIN l0 USING (HEMISPHERE, COMPONENT) GROUP BY ALL),
l2 AS (SELECT HEMISPHERE, COMPONENT, YEAR, pos, ic + slope * YEAR AS fit, y - (ic + slope * YEAR) AS res FROM pt0 JOIN l1 USING (HEMISPHERE, COMPONENT)),
{_draws_sql(7)},
st AS (SELECT f.HEMISPHERE, f.COMPONENT, REP, f.YEAR, f.fit + g.res AS y FROM bi JOIN l2 f ON f.pos = bi.POS JOIN l2 g ON g.HEMISPHERE = f.HEMISPHERE AND g.COMPONENT = f.COMPONENT AND g.pos = bi.SRC),
s2 AS (SELECT a.HEMISPHERE, a.COMPONENT, a.REP, 10 * quantile_cont((b.y - a.y) / (b.YEAR - a.YEAR), 0.5) AS slope FROM st a JOIN st b ON a.HEMISPHERE = b.HEMISPHERE AND a.COMPONENT = b.COMPONENT AND a.REP = b.REP AND a.YEAR < b.YEAR GROUP BY ALL)"""


@query(f"WITH {LONG_COMPONENTS}, {BOOT} SELECT HEMISPHERE, COMPONENT, round(quantile_cont(slope, 0.025), 6) AS ci_low, round(quantile_cont(slope, 0.975), 6) AS ci_high FROM s2 GROUP BY ALL")
def bootstrap_trend_ci(spark: SparkSession, root: str) -> DataFrame:
    return bootstrap.component_intervals(parts(spark, root), ["HEMISPHERE"], **HOW).select("HEMISPHERE", "COMPONENT", *r("ci_low", "ci_high"))


@query(
    f"""WITH {LONG_COMPONENTS}, {BOOT},
s3 AS (SELECT HEMISPHERE, REP, slope / 10 AS slope, quantile_cont(y, 0.5) - any_value(slope) / 10 * quantile_cont(YEAR, 0.5) AS ic FROM st JOIN s2 USING (HEMISPHERE, COMPONENT, REP) WHERE COMPONENT = 'TOTAL' GROUP BY HEMISPHERE, REP, slope),
s4 AS (SELECT HEMISPHERE, y AS YEAR, ic + slope * y AS f FROM s3, generate_series(1995, 2001) t(y))
SELECT s4.HEMISPHERE, s4.YEAR::INT AS YEAR, round(any_value(fit), 6) AS fit, round(quantile_cont(f, 0.025), 6) AS fit_lower, round(quantile_cont(f, 0.975), 6) AS fit_upper
FROM s4 JOIN l2 ON l2.HEMISPHERE = s4.HEMISPHERE AND l2.YEAR = s4.YEAR AND COMPONENT = 'TOTAL' GROUP BY s4.HEMISPHERE, s4.YEAR"""
)
def bootstrap_fit_band(spark: SparkSession, root: str) -> DataFrame:
    b = bootstrap.fit_bands(parts(spark, root), ["HEMISPHERE"], "ANNUAL_MEAN", joint=False, **HOW)
    return b.select("HEMISPHERE", "YEAR", *r("fit", "fit_lower", "fit_upper"))


def _slope_sql(source: str, keys: str, y: str) -> str:
    """A query for (keys, s): Sen slopes by year, 0 with fewer than three points."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""SELECT {ak}, CASE WHEN count(*) >= 3 THEN quantile_cont((b.{y} - a.{y}) / (b.YEAR - a.YEAR), 0.5) ELSE 0 END AS s
  FROM {source} a JOIN {source} b ON {on} AND a.YEAR < b.YEAR WHERE a.{y} IS NOT NULL AND b.{y} IS NOT NULL GROUP BY ALL"""


def _terms_sql(source: str, keys: str, tag: str) -> str:
    """CTEs ending in {tag}z (keys, BAND, migration, intensity, residual, total) from a band table (n, v)."""
    kb = f"{keys}, BAND"
    return f"""{tag}a AS (SELECT {kb}, YEAR, coalesce(n / nullif(sum(n) OVER w, 0), 0) AS share, v / nullif(n, 0) AS mean, coalesce(v / nullif(sum(n) OVER w, 0), 0) AS part FROM {source} WINDOW w AS (PARTITION BY {keys}, YEAR)),
{tag}b AS (SELECT {kb}, avg(share) AS share, coalesce(avg(mean), 0) AS mean FROM {tag}a GROUP BY ALL),
{tag}s AS ({_slope_sql(tag + "a", kb, "share")}), {tag}m AS ({_slope_sql(tag + "a", kb, "mean")}), {tag}p AS ({_slope_sql(tag + "a", kb, "part")}),
{tag}y AS (SELECT {kb}, 10 * coalesce({tag}s.s, 0) * mean AS migration, share * 10 * coalesce({tag}m.s, 0) AS intensity, 10 * coalesce({tag}p.s, 0) AS total
  FROM {tag}b LEFT JOIN {tag}s USING ({kb}) LEFT JOIN {tag}m USING ({kb}) LEFT JOIN {tag}p USING ({kb})),
{tag}z AS (SELECT {kb}, migration, intensity, total - migration - intensity AS residual, total FROM {tag}y)"""


TERMS = ("migration", "intensity", "residual", "total")
BAND_BOOT = f"""{_terms_sql("db", "domain", "o")},
bl AS (SELECT domain, BAND, 'n' AS kind, YEAR, n::DOUBLE AS y FROM db UNION ALL SELECT domain, BAND, 'v', YEAR, v FROM db),
b0 AS ({_slope_sql("bl", "domain, BAND, kind", "y")}),
b1 AS (SELECT domain, BAND, kind, any_value(s) AS s, quantile_cont(y - s * YEAR, 0.5) AS ic FROM bl JOIN b0 USING (domain, BAND, kind) GROUP BY ALL),
b2 AS (SELECT domain, BAND, kind, YEAR, YEAR - 1995 AS pos, ic + s * YEAR AS fit, y - (ic + s * YEAR) AS res FROM bl JOIN b1 USING (domain, BAND, kind)),
{_draws_sql(7)},
b3 AS (SELECT f.domain, f.BAND, f.kind, REP, f.YEAR, greatest(f.fit + g.res, 0) AS y FROM bi JOIN b2 f ON f.pos = bi.POS JOIN b2 g ON g.domain = f.domain AND g.BAND = f.BAND AND g.kind = f.kind AND g.pos = bi.SRC),
b4 AS (SELECT domain, REP, BAND, YEAR, max(y) FILTER (kind = 'n') AS n, max(y) FILTER (kind = 'v') AS v FROM b3 GROUP BY ALL),
{_terms_sql("b4", "domain, REP", "r")}"""


@query(
    f"""WITH {DOMAINS}, {BAND_BOOT}
SELECT domain, BAND, {", ".join(f"round(any_value(oz.{c}), 6) AS {c}_point, round(quantile_cont(rz.{c}, 0.025), 6) AS {c}_ci_low, round(quantile_cont(rz.{c}, 0.975), 6) AS {c}_ci_high" for c in TERMS)}
FROM oz JOIN rz USING (domain, BAND) GROUP BY domain, BAND"""
)
def bootstrap_band_intervals(spark: SparkSession, root: str) -> DataFrame:
    b = bootstrap.band_intervals(domain_bands(spark, root), ["domain"], **HOW)
    return b.select("domain", "BAND", *r(*(c for c in b.columns if c not in ("domain", "BAND"))))


def _cell_sql() -> str:
    one = lambda c: f"replace(printf('%.2f', round(any_value(oz.{c}), 2) + 0.0), '-', '−') || CASE WHEN quantile_cont(rz.{c}, 0.025) > 0 OR quantile_cont(rz.{c}, 0.975) < 0 THEN '*' ELSE '' END"
    return " || ' / ' || ".join(one(c) for c in TERMS[:3])


@query(
    f"""WITH {DOMAINS}, {BAND_BOOT}, ce AS (SELECT domain, BAND, {_cell_sql()} AS cell FROM oz JOIN rz USING (domain, BAND) GROUP BY domain, BAND)
SELECT domain, {", ".join(f"max(cell) FILTER (BAND = {k}) AS band_{k}" for k in range(4))} FROM ce GROUP BY domain"""
)
def compact_table(spark: SparkSession, root: str) -> DataFrame:
    b = bootstrap.band_intervals(domain_bands(spark, root), ["domain"], **HOW)
    return report.compact(b, ["domain"])


@query(
    f"""WITH {LONG_COMPONENTS}, {BOOT}, {trend_sql("lc", "HEMISPHERE, COMPONENT", "value")},
ci AS (SELECT HEMISPHERE, COMPONENT, quantile_cont(slope, 0.025) AS lo, quantile_cont(slope, 0.975) AS hi FROM s2 GROUP BY ALL)
SELECT HEMISPHERE, COMPONENT, round(slope, 6) AS slope, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo > 0 OR hi < 0 AS significant FROM sl JOIN ci USING (HEMISPHERE, COMPONENT)"""
)
def trend_significance(spark: SparkSession, root: str) -> DataFrame:
    p = parts(spark, root)
    ci = bootstrap.component_intervals(p, ["HEMISPHERE"], **HOW)
    return decompose.significance(decompose.component_trends(p, ["HEMISPHERE"]), ci, ["HEMISPHERE", "COMPONENT"]).select("HEMISPHERE", "COMPONENT", *r("slope", "ci_low", "ci_high"), "significant")
