"""Queries: scalar rules, sources, tracks, features, thresholds, events, distributions, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, normal, scalars
from ..operators import audit, dist, events, features, fields, pairs, report, thresholds, tracks
from ..sources.tables import table
from .base import CELLS, EVENTS, ORACLE, band_sql, erfc_sql, query, storm_events, wet_samples


def r(*cols: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def stamp(c: str = "TIME"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


STAMP = "strftime(TIME, '%Y-%m-%d %H:%M:%S') AS TIME"

# --- scalar rules -----------------------------------------------------------------------------------------


@query(
    """SELECT s_suppkey, round(fmod(fmod(x, 360) + 360, 360), 6) AS lon360, round(fmod(fmod(x + 180, 360) + 360, 360) - 180, 6) AS display_lon,
  round(fmod(fmod(x - 350 + 180, 360) + 360, 360) - 180, 6) AS delta, floor(y) + 0.5 AS cell_lat, floor(fmod(fmod(x, 360) + 360, 360)) + 0.5 AS cell_lon,
  least(89.999, greatest(-89.999, y)) AS mask_lat
FROM (SELECT s_suppkey, ((s_suppkey * 37 % 900) - 450)::DOUBLE AS x, ((s_suppkey * 13 % 181) - 90)::DOUBLE AS y FROM supplier)"""
)
def longitudes(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 900 - 450).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 181 - 90).cast("double").alias("y"))
    lat, lon = geo.degree_cell("y", "x")
    cols = {"lon360": geo.lon360("x"), "display_lon": geo.display_lon("x"), "delta": geo.wrapped_delta("x", 350.0)}
    return s.select("s_suppkey", *(F.round(v, 6).alias(k) for k, v in cols.items()), lat.alias("cell_lat"), lon.alias("cell_lon"), geo.mask_position("y", "x")[0].alias("mask_lat"))


@query(
    """SELECT ROW, lat, lon, ROW AS again FROM (SELECT (c_custkey * 4321 % 6480000)::INT AS ROW FROM customer),
LATERAL (SELECT round(89.95 - (ROW // 3600) * 0.1::DOUBLE, 4) AS lat, round((ROW % 3600) * 0.1::DOUBLE + 0.05, 4) AS lon)"""
)
def grid_row_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer").select((F.col("c_custkey") * 4321 % 6_480_000).cast("int").alias("ROW"))
    c = c.select("ROW", geo.row_lat("ROW").alias("a"), geo.row_lon("ROW").alias("b"))
    return c.select("ROW", F.round("a", 4).alias("lat"), F.round("b", 4).alias("lon"), geo.grid_row("a", "b").alias("again"))


PLACES = """su AS (SELECT s_suppkey, ((s_suppkey * 17 % 120) - 60)::DOUBLE AS la, (s_suppkey * 53 % 360)::DOUBLE AS lo FROM supplier),
cu AS (SELECT c_custkey, ((c_custkey * 29 % 120) - 60)::DOUBLE AS cla, (c_custkey * 31 % 360)::DOUBLE AS clo FROM customer),
km AS (SELECT *, fmod(fmod(clo - lo + 180, 360) + 360, 360) - 180 AS d FROM su, cu),
kx AS (SELECT *, pow(sin(radians(cla - la) / 2), 2) + cos(radians(la)) * cos(radians(cla)) * pow(sin(radians(d) / 2), 2) AS a FROM km),
ky AS (SELECT *, 2 * 6371.0 * asin(sqrt(greatest(0, least(1, a)))) AS dist FROM kx)"""


def places(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, root, "supplier").select("s_suppkey", (F.col("s_suppkey") * 17 % 120 - 60).cast("double").alias("la"), (F.col("s_suppkey") * 53 % 360).cast("double").alias("lo"))
    c = table(spark, root, "customer").select("c_custkey", (F.col("c_custkey") * 29 % 120 - 60).cast("double").alias("cla"), (F.col("c_custkey") * 31 % 360).cast("double").alias("clo"))
    return s, c


@query(f"WITH {PLACES} SELECT s_suppkey, c_custkey, round(dist, 4) AS km FROM ky WHERE s_suppkey % 7 = c_custkey % 7")
def haversine_pairs(spark: SparkSession, root: str) -> DataFrame:
    s, c = places(spark, root)
    a = s.select("s_suppkey", (F.col("s_suppkey") % 7).alias("group"), F.col("la").alias("a_lat"), F.col("lo").alias("a_lon"))
    b = c.select("c_custkey", (F.col("c_custkey") % 7).alias("group"), F.col("cla").alias("b_lat"), F.col("clo").alias("b_lon"))
    return pairs.distances(a, b, "s_suppkey", "c_custkey", "group", 4)


@query(f"WITH {EVENTS} SELECT o_orderkey, HEMISPHERE, {band_sql('TC_LAT', 'HEMISPHERE')} AS BAND, CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END AS own FROM ev")
def band_assignment(spark: SparkSession, root: str) -> DataFrame:
    return storm_events(spark, root).select("o_orderkey", "HEMISPHERE", scalars.band("TC_LAT", "HEMISPHERE").alias("BAND"), scalars.hemisphere("TC_LAT").alias("own"))


@query(
    """SELECT p_partkey, CASE WHEN w IS NULL THEN NULL WHEN w <= 33 THEN 'TD' WHEN w <= 63 THEN 'TS' WHEN w <= 82 THEN 'C1' WHEN w <= 95 THEN 'C2' WHEN w <= 112 THEN 'C3' WHEN w <= 136 THEN 'C4' ELSE 'C5' END AS category
FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN (p_partkey * 3 % 180)::DOUBLE END AS w FROM part)"""
)
def intensity_category(spark: SparkSession, root: str) -> DataFrame:
    w = F.when(F.col("p_partkey") % 10 > 0, (F.col("p_partkey") * 3 % 180).cast("double"))
    return table(spark, root, "part").select("p_partkey", scalars.intensity_category(w).alias("category"))


@query("SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, dayofyear(ts)::INT AS d, hour(ts)::INT AS h, printf('%04d%03d.%02d.nc', year(ts), dayofyear(ts), hour(ts)) AS name FROM events")
def time_parts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofyear("ts").alias("d"), F.hour("ts").alias("h"), scalars.file_key("ts").alias("name"))


@query(
    """SELECT p_partkey, try_cast(t AS DOUBLE) AS number, contains(lower(k), 'spur') AS spur, coalesce(regexp_replace(lower(u), ' ', '', 'g') IN ('mm/3h', 'mm/3hr', 'mm/3hour', 'mm3h-1'), false) AS unit_ok
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' || p_size ELSE p_size::VARCHAR || '.5' END AS t,
             CASE p_partkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'SPUR-merge' ELSE '' END AS k, ['mm / 3h', 'MM 3h-1', 'mm/h', 'mm/3hr', 'mm/3Hour', 'mm3h-1', 'mm/(3h)', 'mm(3h)-1', 'mm3hr-1', 'mm/3hours', '', 'mm'][p_partkey % 13 + 1] AS u FROM part)"""
)
def text_coercions(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("x"), "p_size")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    kind = F.when(k % 3 == 0, "main").when(k % 3 == 1, "SPUR-merge").otherwise("")
    spelled = ("mm / 3h", "MM 3h-1", "mm/h", "mm/3hr", "mm/3Hour", "mm3h-1", "mm/(3h)", "mm(3h)-1", "mm3hr-1", "mm/3hours", "", "mm")
    unit = F.get(F.array(*map(F.lit, spelled)), (k % 13).cast("int"))
    return table(spark, root, "part").select("p_partkey", scalars.number_or_null(t).alias("number"), scalars.is_spur(kind).alias("spur"), scalars.units_accepted(unit).alias("unit_ok"))


@query(
    f"WITH {CELLS} SELECT event_id, p > 0.3::FLOAT AS wet, p, round(p::DOUBLE / 3, 5) AS rate, p > (ROW % 7 * 50)::FLOAT AS above FROM (SELECT event_id, ROW, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 11 = 1 THEN 0.3::FLOAT ELSE PRECIP_3H_MM END::FLOAT AS p FROM ce)"
)
def wet_predicate(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("event_id") % 11
    raw = F.when(k == 0, F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(-4.0)).when(k == 1, 0.3).otherwise(F.col("PRECIP_3H_MM")).cast("float")
    c = wet_samples(spark, root).withColumn("p", scalars.dry_if_invalid(raw).cast("float"))
    return c.select("event_id", scalars.is_wet("p").alias("wet"), "p", F.round(scalars.rate(F.col("p").cast("double")), 5).alias("rate"), scalars.exceeds("p", (F.col("ROW") % 7 * 50).cast("float")).alias("above"))


@query(
    f"""WITH {EVENTS} SELECT o_orderkey, CASE WHEN x IS NULL THEN '–' ELSE replace(printf('%.2f', round(x, 2) + 0.0), '-', '−') END AS shown,
  CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE printf('p = %.3f', p) END AS p_text,
  CASE BASIN WHEN 'WP' THEN 'WNP' WHEN 'NI' THEN 'NIO' WHEN 'SI' THEN 'SIO' ELSE BASIN END AS basin,
  x > 1 OR x + 3 < 0 AS significant, x / nullif(o_orderkey % 3, 0) AS ratio
FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN ((o_orderkey % 40) - 20) / 4.0::DOUBLE END AS x, (o_orderkey % 8)::DOUBLE / 1024 AS p FROM ev)"""
)
def display_numbers(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = storm_events(spark, root).select("*", F.when(k % 5 > 0, (k % 40 - 20) / 4).alias("x"), ((k % 8).cast("double") / 1024).alias("p"))
    return e.select(
        "o_orderkey", scalars.shown("x").alias("shown"), scalars.shown_p("p").alias("p_text"), scalars.display_basin("BASIN").alias("basin"),
        scalars.is_significant(F.col("x") - 1, F.col("x") + 3).alias("significant"), scalars.ratio(F.col("x"), k % 3).alias("ratio"),
    )


@query(f"SELECT p_partkey, round({erfc_sql('(p_partkey % 600) / 100.0::DOUBLE')}, 12) AS erfc FROM part")
def erfc_values(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", F.round(normal.erfc(F.col("p_partkey") % 600 / 100), 12).alias("erfc"))


# --- calendar, index, replacement fields ------------------------------------------------------------------


@query(
    f"""WITH {CELLS}, y AS (SELECT min(year(TIME)) AS a, max(year(TIME)) AS z FROM ce),
cal AS (SELECT unnest(generate_series(make_timestamp(a, 1, 1, 0, 0, 0.0), make_timestamp(z, 12, 31, 21, 0, 0.0), INTERVAL 3 HOURS)) AS TIME FROM y),
n AS (SELECT TIME, count(*)::BIGINT AS samples FROM ce GROUP BY ALL)
SELECT strftime(cal.TIME, '%Y-%m-%d %H:%M:%S') AS TIME, printf('%04d%03d.%02d.nc', year(cal.TIME), dayofyear(cal.TIME), hour(cal.TIME)) AS NAME, coalesce(samples, 0)::BIGINT AS samples FROM cal LEFT JOIN n ON cal.TIME = n.TIME"""
)
def calendar_names(spark: SparkSession, root: str) -> DataFrame:
    """The calendar of the samples' years, with the number of samples at each step."""
    c = wet_samples(spark, root).select(F.col("TIME").cast("timestamp").alias("TIME"))
    first, last = c.agg(F.min(F.year("TIME")), F.max(F.year("TIME"))).first()
    n = c.groupBy("TIME").agg(F.count(F.lit(1)).alias("samples"))
    return fields.calendar(spark, first, last).join(n, "TIME", "left").select(stamp(), "NAME", F.coalesce("samples", F.lit(0)).alias("samples"))


@query(
    f"""WITH {CELLS} SELECT NAME FROM (SELECT printf('%04d%03d.%02d.nc', year(t), dayofyear(t), hour(t)) AS NAME FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 21:00', INTERVAL 3 HOURS) s(t))
WHERE NAME NOT IN (SELECT printf('%04d%03d.%02d.nc', year(TIME), dayofyear(TIME), hour(TIME)) FROM ce WHERE event_id % 3 = 0)"""
)
def missing_calendar(spark: SparkSession, root: str) -> DataFrame:
    have = wet_samples(spark, root).where("event_id % 3 = 0").select(scalars.file_key("TIME").alias("NAME")).distinct()
    return fields.missing(fields.calendar(spark, 2024, 2024), have).select("NAME")


@query("SELECT p_brand AS NAME, CASE WHEN min(p_size) % 2 = 0 THEN 'new/' ELSE 'old/' END || min(p_partkey) AS PATH FROM part GROUP BY p_brand")
def index_override(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "part").groupBy(F.col("p_brand").alias("NAME")).agg(F.min("p_size").alias("s"), F.min("p_partkey").alias("k"))
    old = g.select("NAME", F.concat(F.lit("old/"), "k").alias("PATH"))
    return fields.index(old, g.where("s % 2 = 0").select("NAME", F.concat(F.lit("new/"), "k").alias("PATH")))


@query(
    """WITH e AS (SELECT o_orderkey::INT AS ROW, CASE WHEN o_custkey % 13 > 0 THEN (o_totalprice / 1000)::FLOAT END AS x, ((o_custkey % 50) / 8.0::DOUBLE)::FLOAT AS y FROM orders)
SELECT strftime(TIMESTAMP '2020-12-31' + INTERVAL 3 HOURS * k, '%Y-%m-%d %H:%M:%S') AS TIME, ROW, round(((1 - k / 8.0::DOUBLE) * x + k / 8.0::DOUBLE * y)::FLOAT::DOUBLE, 3) AS PRECIP_3H_MM FROM e, generate_series(1, 7) t(k)"""
)
def blend_fields(spark: SparkSession, root: str) -> DataFrame:
    """Two fields a day apart, with a cell for each order, and the seven replacements between them."""
    o = table(spark, root, "orders")
    lo, hi = F.lit("2020-12-31 00:00:00").cast("timestamp"), F.lit("2021-01-01 00:00:00").cast("timestamp")
    before = F.when(F.col("o_custkey") % 13 > 0, (F.col("o_totalprice") / 1000).cast("float"))
    ends = F.array(F.struct(lo.alias("TIME"), before.alias("v")), F.struct(hi.alias("TIME"), (F.col("o_custkey") % 50 / 8).cast("float").alias("v")))
    f = o.select(F.col("o_orderkey").cast("int").alias("ROW"), F.explode(ends).alias("e")).select("e.TIME", "ROW", F.col("e.v").alias("PRECIP_3H_MM"))
    plan = fields.calendar(spark, 2020, 2020).where(F.col("TIME") > lo).select("TIME", lo.alias("BEFORE"), hi.alias("AFTER"))
    return fields.replacements(f, plan).select(stamp(), "ROW", F.round(F.col("PRECIP_3H_MM").cast("double"), 3).alias("PRECIP_3H_MM"))


# Every second step has a field, of ten cells, and so has the first after a longer gap.
GAPPED = """ga AS (SELECT TIMESTAMP '2020-01-01' + INTERVAL 3 HOURS * (CASE WHEN l_linenumber = 6 THEN 16 ELSE 2 * (l_linenumber - 1) END) AS TIME, (l_partkey % 10)::INT AS ROW, avg(l_extendedprice)::FLOAT AS v FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL),
st AS (SELECT TIMESTAMP '2020-01-01' + INTERVAL 3 HOURS * k AS TIME FROM generate_series(0, 16) t(k)),
pl AS (SELECT TIME, (SELECT max(TIME) FROM ga WHERE ga.TIME < st.TIME) AS a, (SELECT min(TIME) FROM ga WHERE ga.TIME > st.TIME) AS z FROM st WHERE TIME NOT IN (SELECT TIME FROM ga)),
pw AS (SELECT *, epoch(TIME - a) / epoch(z - a) AS w FROM pl)"""


def gapped(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    step = F.when(F.col("l_linenumber") == 6, 16).otherwise(2 * (F.col("l_linenumber") - 1))
    li = table(spark, root, "lineitem").where("l_linenumber <= 6")
    f = li.groupBy(F.timestamp_seconds(F.lit(1_577_836_800) + step * 10800).alias("TIME"), (F.col("l_partkey") % 10).cast("int").alias("ROW")).agg(F.avg("l_extendedprice").cast("float").alias("PRECIP_3H_MM"))
    steps = fields.calendar(spark, 2020, 2020).where(F.col("TIME") <= F.timestamp_seconds(F.lit(1_577_836_800 + 16 * 10800)))
    return f, fields.gaps(steps, f)


@query(f"WITH {GAPPED} SELECT strftime(TIME, '%Y-%m-%d %H:%M:%S') AS TIME, x.ROW, round(((1 - w) * x.v + w * y.v)::FLOAT::DOUBLE, 1) AS PRECIP_3H_MM FROM pw JOIN ga x ON x.TIME = a JOIN ga y ON y.TIME = z AND x.ROW = y.ROW".replace("strftime(TIME,", "strftime(pw.TIME,"))
def replaced_gaps(spark: SparkSession, root: str) -> DataFrame:
    f, plan = gapped(spark, root)
    return fields.replacements(f, plan).select(stamp(), "ROW", F.round(F.col("PRECIP_3H_MM").cast("double"), 1).alias("PRECIP_3H_MM"))


NAMED = "printf('%04d%03d.%02d.nc', year({0}), dayofyear({0}), hour({0}))"


@query(f"WITH {GAPPED} SELECT {NAMED.format('TIME')} AS NAME, {NAMED.format('a')} AS SOURCE_BEFORE, {NAMED.format('z')} AS SOURCE_AFTER, round(1 - w, 9) AS WEIGHT_BEFORE, round(w, 9) AS WEIGHT_AFTER FROM pw")
def replacement_provenance(spark: SparkSession, root: str) -> DataFrame:
    return fields.provenance(gapped(spark, root)[1]).select("NAME", "SOURCE_BEFORE", "SOURCE_AFTER", *r("WEIGHT_BEFORE", "WEIGHT_AFTER", digits=9))


# --- tracks -----------------------------------------------------------------------------------------------

RAW = """rt AS (
  SELECT 'T' || (o_custkey % 60) || '-' || strftime(o_orderdate, '%Y%m') || '-' || (o_orderkey // 150000) AS SID, date_trunc('month', o_orderdate) + INTERVAL 6 HOURS * (o_orderkey % 30) + CASE WHEN o_custkey % 60 = 7 THEN INTERVAL 3 HOURS ELSE INTERVAL 0 HOURS END AS TIME,
         ((o_orderkey % 80) - 40)::DOUBLE / 2 AS LAT, (340 + o_orderkey % 40)::DOUBLE AS LON, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 150)::DOUBLE END AS USA_WIND,
         ['WP', 'EP', 'NA', 'NI', 'SI', 'SP', 'SA'][o_custkey % 60 % 7 + 1] AS BASIN
  FROM orders),
d0 AS (SELECT SID, TIME, fmod(LAT * 0 + LON, 360) AS LON, LAT, USA_WIND, BASIN, row_number() OVER (PARTITION BY SID, TIME ORDER BY LAT, fmod(LON, 360), USA_WIND NULLS LAST) AS k FROM rt),
d1 AS (SELECT * EXCLUDE k FROM d0 WHERE k = 1),
an AS (SELECT * FROM d1 WHERE hour(TIME) % 6 = 0),
u0 AS (SELECT *, coalesce(fmod(fmod(LON - lag(LON) OVER (PARTITION BY SID ORDER BY TIME) + 180, 360) + 360, 360) - 180, 0) AS st FROM an),
un AS (SELECT *, first_value(LON) OVER w + sum(st) OVER w AS u FROM u0 WINDOW w AS (PARTITION BY SID ORDER BY TIME ROWS UNBOUNDED PRECEDING))"""


# Batch and month in SID keep tracks short at every size.


def all_raw_rows(spark: SparkSession, root: str) -> DataFrame:
    from .base import BASINS

    sid, key = F.col("o_custkey") % 60, F.col("o_orderkey")
    start = F.unix_timestamp(F.date_trunc("month", "o_orderdate"))
    t = F.timestamp_seconds(start + 21600 * (key % 30) + F.when(sid == 7, 10800).otherwise(0))
    return table(spark, root, "orders").select(
        F.concat(F.lit("T"), sid, F.lit("-"), F.date_format("o_orderdate", "yyyyMM"), F.lit("-"), F.floor(key / 150000)).alias("SID"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"), ((key % 80 - 40).cast("double") / 2).cast("string").alias("LAT"),
        (F.lit(340) + key % 40).cast("string").alias("LON"), F.when(key % 4 > 0, (key % 150).cast("string")).otherwise(" ").alias("USA_WIND"),
        F.lit("").alias("USA_PRES"), F.get(F.array(*map(F.lit, BASINS)), (sid % 7).cast("int")).alias("BASIN"), F.lit("main").alias("TRACK_TYPE"),
    )


def prepared_all(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    t = tracks.prepare(all_raw_rows(spark, root), first, last)
    return t.select("SID", stamp(), *r("LAT", "LON", "USA_WIND"), "BASIN", F.col("YEAR").cast("int").alias("Y"), F.col("MONTH").cast("int").alias("M"), "INTENSITY_CAT")


@query(
    f"""WITH {RAW},
li AS (SELECT SID, min(TIME) AS a, max(TIME) AS b FROM an GROUP BY SID),
ti AS (SELECT SID, unnest(generate_series(a, b, INTERVAL 3 HOURS)) AS TIME FROM li),
al AS (SELECT ti.SID, ti.TIME, LAT, u, USA_WIND, BASIN FROM ti LEFT JOIN un USING (SID, TIME)),
br AS (SELECT *,
   last_value(CASE WHEN LAT IS NOT NULL THEN struct_pack(t := epoch(TIME), v := LAT) END IGNORE NULLS) OVER p AS la, first_value(CASE WHEN LAT IS NOT NULL THEN struct_pack(t := epoch(TIME), v := LAT) END IGNORE NULLS) OVER f AS lb,
   last_value(CASE WHEN u IS NOT NULL THEN struct_pack(t := epoch(TIME), v := u) END IGNORE NULLS) OVER p AS oa, first_value(CASE WHEN u IS NOT NULL THEN struct_pack(t := epoch(TIME), v := u) END IGNORE NULLS) OVER f AS ob,
   last_value(CASE WHEN USA_WIND IS NOT NULL THEN struct_pack(t := epoch(TIME), v := USA_WIND) END IGNORE NULLS) OVER p AS wa, first_value(CASE WHEN USA_WIND IS NOT NULL THEN struct_pack(t := epoch(TIME), v := USA_WIND) END IGNORE NULLS) OVER f AS wb,
   coalesce(last_value(BASIN IGNORE NULLS) OVER p, first_value(BASIN IGNORE NULLS) OVER f) AS bs
  FROM al WINDOW p AS (PARTITION BY SID ORDER BY TIME ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY SID ORDER BY TIME ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
nt AS (SELECT SID, TIME, CASE WHEN la.t = lb.t THEN la.v ELSE la.v + (lb.v - la.v) * (epoch(TIME) - la.t) / (lb.t - la.t) END AS LAT,
   CASE WHEN oa.t = ob.t THEN oa.v ELSE oa.v + (ob.v - oa.v) * (epoch(TIME) - oa.t) / (ob.t - oa.t) END AS LON,
   CASE WHEN wa.t = wb.t THEN wa.v ELSE wa.v + (wb.v - wa.v) * (epoch(TIME) - wa.t) / (wb.t - wa.t) END AS W, bs AS BASIN FROM br
  UNION ALL SELECT SID, TIME, LAT, LON, USA_WIND, BASIN FROM d1 WHERE SID NOT IN (SELECT SID FROM an) AND hour(TIME) % 3 = 0)
SELECT SID, {STAMP}, round(LAT, 6) AS LAT, round(fmod(fmod(LON, 360) + 360, 360), 6) AS LON, round(W, 6) AS USA_WIND, BASIN, year(TIME)::INT AS Y, month(TIME)::INT AS M,
   CASE WHEN W IS NULL THEN NULL WHEN W <= 33 THEN 'TD' WHEN W <= 63 THEN 'TS' WHEN W <= 82 THEN 'C1' WHEN W <= 95 THEN 'C2' WHEN W <= 112 THEN 'C3' WHEN W <= 136 THEN 'C4' ELSE 'C5' END AS INTENSITY_CAT FROM nt"""
)
def track_prepare(spark: SparkSession, root: str) -> DataFrame:
    return prepared_all(spark, root, 1900, 2100)


@query(f"WITH {RAW} SELECT SID, {STAMP}, u, abs(st) > 10 AS jump FROM un")
def track_unwrap(spark: SparkSession, root: str) -> DataFrame:
    return unwrapped_steps(all_raw_rows(spark, root))


def unwrapped_steps(raw: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    rows = tracks.one_per_time(tracks.cleaned(raw)).where(scalars.on_hours("TIME", 6))
    step = geo.wrapped_delta("LON", F.lag("LON").over(Window.partitionBy("SID").orderBy("TIME")))
    return tracks.unwrapped(rows, "u").withColumn("jump", F.coalesce(F.abs(step) > 10, F.lit(False))).select("SID", stamp(), "u", "jump")


@query(f"WITH {RAW} SELECT SID, {STAMP}, LAT FROM d1 WHERE TIME IN (SELECT DISTINCT TIME FROM d1 ORDER BY TIME LIMIT 40) AND SID IN ('T1-199501-0', 'T2-199501-0', 'T3-199501-0', 'T7-199501-0')")
def tracks_within(spark: SparkSession, root: str) -> DataFrame:
    rows = tracks.one_per_time(tracks.cleaned(all_raw_rows(spark, root)))
    return tracks.within(tracks.within(rows, first_times=40), storms=[f"T{k}-199501-0" for k in (1, 2, 3, 7)]).select("SID", stamp(), "LAT")


# --- features ---------------------------------------------------------------------------------------------

STORMS = """sf AS (SELECT DISTINCT (s_suppkey % 4)::INT AS k, 'F' || (s_suppkey % 6) AS SID, ((s_suppkey % 6) * 9 - 20)::DOUBLE AS LAT, (s_suppkey % 6 * 2 + 355)::DOUBLE - CASE WHEN s_suppkey % 6 * 2 + 355 >= 360 THEN 360 ELSE 0 END AS LON FROM supplier),
gc AS (SELECT DISTINCT (l_linenumber % 4)::INT AS k, (((l_partkey * 7 % 110) * 5 + 600) * 3600 + (((l_suppkey * 11 % 60) * 5 + 3450) % 3600))::INT AS ROW FROM lineitem),
gf AS (SELECT k, ROW, round(((ROW % 97) / 90.0)::FLOAT, 3)::FLOAT AS p, 89.95 - (ROW // 3600) * 0.1::DOUBLE AS gla, (ROW % 3600) * 0.1::DOUBLE + 0.05 AS glo FROM gc),
cn AS (SELECT SID, k, LAT, LON, ROW, p, gla, glo, fmod(fmod(glo - LON + 180, 360) + 360, 360) - 180 AS dl FROM sf JOIN gf USING (k)),
ca AS (SELECT *, 2 * 6371.0 * asin(sqrt(greatest(0, least(1, pow(sin(radians(gla - LAT) / 2), 2) + cos(radians(LAT)) * cos(radians(gla)) * pow(sin(radians(dl) / 2), 2))))) AS km FROM cn
  WHERE abs(gla - LAT) <= 1000.0 / 111.0 AND abs(dl) <= least(1000.0 / (111.0 * greatest(cos(radians(LAT)), 0.08)), 170))"""


def storm_fields(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    at = lambda c: F.timestamp_seconds(F.lit(1_704_067_200) + c * 10800)
    k = F.col("s_suppkey") % 6
    s = table(spark, root, "supplier").select(at(F.col("s_suppkey") % 4).alias("TIME"), F.concat(F.lit("F"), k).alias("SID"), F.lit("WP").alias("BASIN"), (k * 9 - 20).cast("double").alias("LAT"), geo.lon360((k * 2 + 355).cast("double")).alias("LON")).distinct()
    row = ((F.col("l_partkey") * 7 % 110 * 5 + 600) * 3600 + (F.col("l_suppkey") * 11 % 60 * 5 + 3450) % 3600).cast("int")
    f = table(spark, root, "lineitem").select(at(F.col("l_linenumber") % 4).alias("TIME"), row.alias("ROW")).distinct()
    return s, f.select("TIME", "ROW", F.round((F.col("ROW") % 97 / 90).cast("float"), 3).cast("float").alias("PRECIP_3H_MM"), F.lit(False).alias("IS_INTERPOLATED"))


@query(f"WITH {STORMS} SELECT SID, k, ROW, round(km, 3) AS km FROM ca")
def range_join_1000km(spark: SparkSession, root: str) -> DataFrame:
    c = features.candidates(*storm_fields(spark, root))
    return c.select("SID", ((F.unix_timestamp("TIME") - 1_704_067_200) / 10800).cast("int").alias("k"), "ROW", F.round("DIST_KM", 3).alias("km"))


BLOBS = """bl AS (SELECT DISTINCT (l_orderkey // 100)::INT AS k, ((900 + l_partkey % 24) * 3600 + (3588 + l_suppkey * 5 % 24 + l_quantity::INT % 2) % 3600)::INT AS ROW FROM lineitem),
bc AS (SELECT k, ROW, ROW // 3600 AS i, (ROW % 3600 + 20) % 3600 AS j FROM bl),
nb AS (SELECT a.k, a.ROW AS u, b.ROW AS v, b.i, b.j FROM bc a JOIN bc b ON a.k = b.k AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
re AS (SELECT k, ROW, ROW AS g, i, j FROM bc UNION SELECT re.k, re.ROW, nb.v, nb.i, nb.j FROM re JOIN nb ON nb.k = re.k AND nb.u = re.g),
fe AS (SELECT k, ROW, first(g ORDER BY i, j) AS FEATURE FROM re GROUP BY ALL)"""


def all_blobs(spark: SparkSession, root: str) -> DataFrame:
    """A hundred order keys to a time step, so that regions do not fill the grid at any size."""
    return blob_cells(table(spark, root, "lineitem"), F.floor(F.col("l_orderkey") / 100))


def blob_cells(li: DataFrame, k) -> DataFrame:
    row = ((900 + F.col("l_partkey") % 24) * 3600 + (3588 + F.col("l_suppkey") * 5 % 24 + F.col("l_quantity").cast("int") % 2) % 3600).cast("int")
    b = li.select(k.cast("int").alias("k"), row.alias("ROW")).distinct()
    b = b.select("k", F.lit("S").alias("SID"), F.timestamp_seconds(F.col("k") * 10800).alias("TIME"), F.lit(0.0).alias("LAT"), F.lit(0.0).alias("LON"), "ROW", geo.row_lat("ROW").alias("GRID_LAT"), geo.wrapped_delta(geo.row_lon("ROW"), 0.0).alias("DLON"))
    return b


@query(f"WITH RECURSIVE {BLOBS} SELECT k, ROW, FEATURE FROM fe")
def connected_components(spark: SparkSession, root: str) -> DataFrame:
    return features.labelled(all_blobs(spark, root)).select("k", "ROW", "FEATURE")


@query(
    f"""WITH RECURSIVE {BLOBS}, gp AS (SELECT *, 89.95 - (ROW // 3600) * 0.1::DOUBLE AS la, fmod((ROW % 3600) * 0.1::DOUBLE + 0.05 + 180, 360) - 180 AS dl FROM fe),
ct AS (SELECT k, FEATURE, avg(la) AS la, avg(dl) AS dl FROM gp GROUP BY ALL),
cd AS (SELECT k, FEATURE FROM ct WHERE 2 * 6371.0 * asin(sqrt(pow(sin(radians(la) / 2), 2) + cos(radians(la)) * pow(sin(radians(dl) / 2), 2))) <= 200)
SELECT k, ROW, FEATURE FROM fe JOIN cd USING (k, FEATURE)"""
)
def feature_centroid_filter(spark: SparkSession, root: str) -> DataFrame:
    return features.centred(features.labelled(all_blobs(spark, root)), 200.0).select("k", "ROW", "FEATURE")


@query(
    f"""WITH RECURSIVE {STORMS}, we AS (SELECT *, ROW // 3600 AS i, round_even((dl + LON) * 10 - 0.5, 0)::BIGINT AS j FROM ca WHERE p > 0.3::FLOAT AND km <= 1000),
ad AS (SELECT a.SID, a.k, a.ROW AS u, b.ROW AS v, b.i, b.j FROM we a JOIN we b ON a.SID = b.SID AND a.k = b.k AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
rc AS (SELECT SID, k, ROW, ROW AS g, i, j FROM we UNION SELECT rc.SID, rc.k, rc.ROW, ad.v, ad.i, ad.j FROM rc JOIN ad ON ad.SID = rc.SID AND ad.k = rc.k AND ad.u = rc.g),
lb AS (SELECT SID, k, ROW, first(g ORDER BY i, j) AS f FROM rc GROUP BY ALL),
ce AS (SELECT SID, k, f, any_value(LAT) AS LAT, avg(gla) AS la, avg(dl) AS dl FROM we JOIN lb USING (SID, k, ROW) GROUP BY ALL),
ok AS (SELECT SID, k, f FROM ce WHERE 2 * 6371.0 * asin(sqrt(pow(sin(radians(la - LAT) / 2), 2) + cos(radians(LAT)) * cos(radians(la)) * pow(sin(radians(dl) / 2), 2))) <= 500)
SELECT SID, strftime(TIMESTAMP '2024-01-01' + INTERVAL 3 HOURS * k, '%Y-%m-%d %H:%M:%S') AS TIME, 2024 AS YEAR, ROW, round(p::DOUBLE, 4) AS p, round((p / 3)::FLOAT::DOUBLE, 4) AS rate, false AS IS_INTERPOLATED_TIMESTEP
FROM we JOIN lb USING (SID, k, ROW) JOIN ok USING (SID, k, f)"""
)
def attributed_cells(spark: SparkSession, root: str) -> DataFrame:
    a = features.attributed(*storm_fields(spark, root))
    return a.select("SID", stamp(), F.col("YEAR").cast("int").alias("YEAR"), "ROW", F.round(F.col("PRECIP_3H_MM").cast("double"), 4).alias("p"), F.round(F.col("PRECIP_MMHR").cast("double"), 4).alias("rate"), "IS_INTERPOLATED_TIMESTEP")


# --- thresholds and events --------------------------------------------------------------------------------


def _edge_list() -> str:
    return "[" + ", ".join(repr(float(e)) for e in thresholds.edges()) + "]::FLOAT[]"


POT = f"""wt AS (SELECT ROW, PRECIP_3H_MM AS v FROM ce WHERE PRECIP_3H_MM > 0.3::FLOAT),
ex AS (SELECT ROW, v, row_number() OVER (PARTITION BY ROW ORDER BY v) AS k, count(*) OVER (PARTITION BY ROW) AS n FROM wt),
ep AS (SELECT ROW, n::BIGINT AS N_WET, v AS POT99 FROM ex WHERE k = ceil(0.99::DOUBLE * n)),
ed AS (SELECT {_edge_list()} AS e),
hb AS (SELECT ROW, CASE WHEN v > 120::FLOAT THEN 500 ELSE len(list_filter(e[2:], lambda x: x < v)) END::INT AS BIN FROM wt, ed),
hi AS (SELECT ROW, BIN, count(*)::BIGINT AS N FROM hb GROUP BY ALL),
hc AS (SELECT *, sum(N) OVER (PARTITION BY ROW)::BIGINT AS t, sum(N) OVER (PARTITION BY ROW ORDER BY BIN) AS c FROM hi),
hp AS (SELECT ROW, max(t) AS N_WET, min(BIN) AS b FROM hc WHERE c >= ceil(0.99::DOUBLE * t) GROUP BY ROW),
ht AS (SELECT ROW, N_WET, CASE WHEN b < 500 THEN (e[b + 1] + e[b + 2]) / 2::FLOAT END AS POT99, CASE WHEN b < 500 THEN 'histogram' ELSE 'unresolved' END AS THRESHOLD_METHOD FROM hp, ed)"""


def small_wet(spark: SparkSession, root: str) -> DataFrame:
    """Samples scaled so that some rows end inside the bins and some above them."""
    c = wet_samples(spark, root)
    return c.withColumn("PRECIP_3H_MM", (F.col("PRECIP_3H_MM").cast("double") * (1 + F.col("ROW") % 3) / 3).cast("float"))


SCALED = CELLS.replace("value::FLOAT AS PRECIP_3H_MM", "(value::FLOAT::DOUBLE * (1 + (user_id % 100) % 3) / 3)::FLOAT AS PRECIP_3H_MM")


def rounded(c: str, digits: int = 4):
    return F.round(F.col(c).cast("double"), digits).alias(c)


@query(f"WITH {SCALED}, {POT} SELECT ROW, N_WET, round(POT99::DOUBLE, 4) AS POT99 FROM ep")
def pot_exact(spark: SparkSession, root: str) -> DataFrame:
    return thresholds.exact(small_wet(spark, root), "PRECIP_3H_MM").select("ROW", "N_WET", rounded("POT99"))


@query(f"WITH {SCALED}, {POT} SELECT ROW, BIN, N FROM hi")
def pot_histogram(spark: SparkSession, root: str) -> DataFrame:
    c = small_wet(spark, root)
    return thresholds.merged(thresholds.histogram(c.where("event_id % 2 = 0"), "PRECIP_3H_MM"), thresholds.histogram(c.where("event_id % 2 = 1"), "PRECIP_3H_MM"))


@query(f"WITH {SCALED}, {POT} SELECT ROW, N_WET, round(POT99::DOUBLE, 4) AS POT99, THRESHOLD_METHOD FROM ht")
def pot_from_histogram(spark: SparkSession, root: str) -> DataFrame:
    return thresholds.from_histogram(thresholds.histogram(small_wet(spark, root), "PRECIP_3H_MM")).select("ROW", "N_WET", rounded("POT99"), "THRESHOLD_METHOD")


@query(
    f"""WITH {SCALED}, {POT} SELECT ROW, ht.N_WET, round(CASE WHEN THRESHOLD_METHOD = 'histogram' THEN ht.POT99 ELSE ep.POT99 END::DOUBLE, 4) AS POT99,
CASE WHEN THRESHOLD_METHOD = 'histogram' THEN 'histogram' ELSE 'exact' END AS THRESHOLD_METHOD FROM ht JOIN ep USING (ROW)"""
)
def pot_refined(spark: SparkSession, root: str) -> DataFrame:
    return thresholds.refined(small_wet(spark, root), "PRECIP_3H_MM").select("ROW", "N_WET", rounded("POT99"), "THRESHOLD_METHOD")


LOCAL = """th AS (SELECT ROW, CASE WHEN ROW % 9 = 0 THEN 'NaN'::FLOAT ELSE (150 + ROW)::FLOAT END AS POT99_MM_3H FROM (SELECT DISTINCT ROW FROM ce) WHERE ROW % 10 > 0),
xc AS (SELECT ce.*, POT99_MM_3H FROM ce JOIN th USING (ROW) WHERE NOT isnan(POT99_MM_3H) AND PRECIP_3H_MM > POT99_MM_3H),
ne AS (SELECT SID, TIME, min(BASIN) AS BASIN, min(TC_LAT) AS TC_LAT, avg(PRECIP_3H_MM::DOUBLE) AS m, count(*)::BIGINT AS N_EXTREME_CELLS, bool_or(IS_INTERPOLATED_TIMESTEP) AS IS_INTERPOLATED_TIMESTEP FROM xc GROUP BY ALL)"""


def local_thresholds(c: DataFrame) -> DataFrame:
    return c.select("ROW").distinct().where("ROW % 10 > 0").withColumn("POT99_MM_3H", F.when(F.col("ROW") % 9 == 0, float("nan")).otherwise(150 + F.col("ROW")).cast("float"))


def extreme(spark: SparkSession, root: str) -> DataFrame:
    c = wet_samples(spark, root)
    return events.extreme_cells(c, events.checked_thresholds(local_thresholds(c)))


@query(f"WITH {CELLS}, {LOCAL} SELECT event_id, ROW, {STAMP}, round(POT99_MM_3H::DOUBLE, 3) AS POT99_MM_3H FROM xc")
def exceedance_cells(spark: SparkSession, root: str) -> DataFrame:
    return extreme(spark, root).select("event_id", "ROW", stamp(), rounded("POT99_MM_3H", 3))


EVENT_SQL = f"""WITH {CELLS}, {LOCAL} SELECT SID, {STAMP}, year(TIME)::INT AS YEAR, CASE WHEN TC_LAT >= 0 THEN 'NH' ELSE 'SH' END AS HEMISPHERE, BASIN, TC_LAT, round(m, 6) AS EVENT_INTENSITY_MM_3H, N_EXTREME_CELLS, IS_INTERPOLATED_TIMESTEP FROM ne"""


def event_columns(e: DataFrame) -> DataFrame:
    return e.select("SID", stamp(), "YEAR", "HEMISPHERE", "BASIN", "TC_LAT", *r("EVENT_INTENSITY_MM_3H"), "N_EXTREME_CELLS", "IS_INTERPOLATED_TIMESTEP")


@query(EVENT_SQL)
def event_build(spark: SparkSession, root: str) -> DataFrame:
    return event_columns(events.build_events(extreme(spark, root)))


@query(EVENT_SQL)
def event_partial_final(spark: SparkSession, root: str) -> DataFrame:
    x = extreme(spark, root)
    return event_columns(events.merged_events(*(events.partial_events(x.where(F.col("event_id") % 3 == k)) for k in range(3))))


# --- distributions ----------------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY ALL")
def band_quantiles(spark: SparkSession, root: str) -> DataFrame:
    return dist.quantiles(table(spark, root, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", *r("q10", "q50", "q90", "q99"))


@query(
    """WITH y AS (SELECT l_returnflag, year(l_shipdate) AS y, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*)::BIGINT AS n, round(median(l_extendedprice), 6) AS median, (SELECT round(avg(m), 6) FROM y WHERE y.l_returnflag = l.l_returnflag) AS mean_of_years FROM lineitem l GROUP BY l_returnflag"""
)
def medians_and_counts(spark: SparkSession, root: str) -> DataFrame:
    li = table(spark, root, "lineitem").withColumn("YEAR", F.year("l_shipdate"))
    return dist.medians_and_counts(li, ["l_returnflag"], "l_extendedprice").select("l_returnflag", "n", *r("median", "mean_of_years"))


@query(
    """WITH h AS (SELECT l_returnflag, CASE WHEN l_quantity >= 1 AND l_quantity < 41 THEN least(floor((l_quantity - 1) / 1.0), 39) WHEN l_quantity = 41 THEN 39 END::INT AS BIN FROM lineitem),
t AS (SELECT l_returnflag, count(*) AS t FROM h GROUP BY ALL)
SELECT l_returnflag, BIN, 1.0 + BIN AS "left", count(*)::BIGINT AS n, round(count(*) / any_value(t), 9) AS density FROM h JOIN t USING (l_returnflag) WHERE BIN IS NOT NULL GROUP BY l_returnflag, BIN"""
)
def hist_density(spark: SparkSession, root: str) -> DataFrame:
    h = dist.histogram_density(table(spark, root, "lineitem"), ["l_returnflag"], "l_quantity", 1.0, 41.0)
    return h.select("l_returnflag", "BIN", "left", "n", *r("density", digits=9))


@query(
    """WITH s AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY ALL),
g AS (SELECT k, 0 + k * (60.0::DOUBLE / 399) AS x FROM generate_series(0, 399) t(k)), q AS (SELECT l_returnflag, l_quantity AS v, count(*) AS w FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(x, 6) AS x, round(sum(w * exp(-pow((x - v) / h, 2) / 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()), 9) AS density FROM q JOIN s USING (l_returnflag), g GROUP BY l_returnflag, x"""
)
def kde_grid(spark: SparkSession, root: str) -> DataFrame:
    return dist.kernel_density(table(spark, root, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 60.0).select("l_returnflag", *r("x"), *r("density", digits=9))


# --- audits -----------------------------------------------------------------------------------------------


@query(
    f"""WITH {CELLS}, {LOCAL}, old AS (SELECT SID, TIME, CASE WHEN N_EXTREME_CELLS % 5 = 1 THEN m + 1 ELSE m END AS m, N_EXTREME_CELLS AS n FROM ne WHERE day(TIME) % 6 > 0)
SELECT coalesce(old.SID, ne.SID) AS SID, strftime(coalesce(old.TIME, ne.TIME), '%Y-%m-%d %H:%M:%S') AS TIME, CASE WHEN old.SID IS NULL THEN 'missing' ELSE 'mean' END AS problem
FROM old FULL JOIN ne ON old.SID = ne.SID AND old.TIME = ne.TIME WHERE old.SID IS NULL OR abs(old.m - ne.m) > 1e-6"""
)
def audit_event_reaggregation(spark: SparkSession, root: str) -> DataFrame:
    x = extreme(spark, root)
    old = events.build_events(x).where(F.dayofmonth("TIME") % 6 > 0)
    old = old.withColumn("EVENT_INTENSITY_MM_3H", F.when(F.col("N_EXTREME_CELLS") % 5 == 1, F.col("EVENT_INTENSITY_MM_3H") + 1).otherwise(F.col("EVENT_INTENSITY_MM_3H")))
    return audit.reaggregated(old, x).select("SID", stamp(), "problem")


@query(
    f"""WITH {CELLS}, x AS (SELECT *, (ROW % 5 = 0) <> (PRECIP_3H_MM > 120::FLOAT) AS odd FROM (SELECT DISTINCT ON (ROW, event_id % 2) ROW, event_id % 2 AS e, min(event_id) OVER (PARTITION BY ROW, event_id % 2) AS i, PRECIP_3H_MM FROM ce QUALIFY event_id = i))
SELECT 'finite' AS "check", sum((NOT PRECIP_3H_MM > 0.3::FLOAT)::INT)::BIGINT AS failures FROM x UNION ALL SELECT 'count', 0 UNION ALL SELECT 'exact above the bins', sum(odd::INT)::BIGINT FROM x UNION ALL SELECT 'row', 0 UNION ALL SELECT 'wet sample rule', sum((ROW % 3 = 0)::INT)::BIGINT FROM x UNION ALL SELECT 'exact cells', 1
UNION ALL SELECT 'duplicate keys', (count(*) - count(DISTINCT ROW))::BIGINT FROM x"""
)
def audit_thresholds(spark: SparkSession, root: str) -> DataFrame:
    c = wet_samples(spark, root)
    t = c.groupBy("ROW", (F.col("event_id") % 2).alias("e")).agg(F.min_by("PRECIP_3H_MM", "event_id").alias("POT99_MM_3H"))
    rule = F.when(F.col("ROW") % 3 == 0, ">=0.3 mm/3h").otherwise(thresholds.WET_SAMPLE_RULE).alias("WET_SAMPLE_RULE")
    return audit.thresholds(t.select("ROW", "POT99_MM_3H", F.lit(1).alias("N_WET"), (F.col("ROW") % 5 == 0).alias("IS_EXACT_TAIL_REFINEMENT"), rule), exact_cells=-1)


@query(
    f"""WITH {CELLS} SELECT 'latitude bounds' AS "check", 0::BIGINT AS failures UNION ALL SELECT 'longitude bounds', sum((PRECIP_3H_MM > 360)::INT)::BIGINT FROM ce UNION ALL SELECT 'track time', 0
UNION ALL SELECT 'duplicate positions', (count(*) - count(DISTINCT (SID, TIME)))::BIGINT FROM ce
UNION ALL SELECT 'missing files', (2928 - count(DISTINCT TIME))::BIGINT FROM ce UNION ALL SELECT 'extra files', 1"""
)
def audit_inputs(spark: SparkSession, root: str) -> DataFrame:
    c = wet_samples(spark, root).select("SID", "TIME", F.col("TC_LAT").alias("LAT"), F.col("PRECIP_3H_MM").alias("LON"))
    names = fields.calendar(spark, 2024, 2024)
    files = c.select(scalars.file_key("TIME").alias("NAME")).distinct().unionByName(spark.createDataFrame([("2023001.00.nc",)], "NAME string"))
    return audit.inputs(c, names, files)


@query(
    f"""WITH {CELLS} SELECT year(TIME)::INT AS YEAR, count(*)::BIGINT AS rows, count(DISTINCT SID)::BIGINT AS storms, count(DISTINCT TIME)::BIGINT AS times, 'WP' AS basins, min(PRECIP_3H_MM) AS least, max(PRECIP_3H_MM) AS most, sum(IS_INTERPOLATED_TIMESTEP::INT)::BIGINT AS interpolated FROM ce GROUP BY ALL"""
)
def audit_summary(spark: SparkSession, root: str) -> DataFrame:
    c = wet_samples(spark, root).withColumn("YEAR", F.year("TIME"))
    return audit.cell_summary(c).withColumn("basins", F.concat_ws(",", "basins"))


@query("SELECT 'monotonic axis' AS \"check\", count(*)::BIGINT AS failures FROM (SELECT s_acctbal - lag(s_acctbal) OVER (ORDER BY s_suppkey) AS d FROM supplier) WHERE d >= 0")
def audit_axis(spark: SparkSession, root: str) -> DataFrame:
    return audit.monotonic(table(spark, root, "supplier"), "s_suppkey", "s_acctbal", block=16)


@query("SELECT 'monotonic axis' AS \"check\", count(*)::BIGINT AS failures FROM (SELECT o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey) AS d FROM orders) WHERE d <= 0")
def audit_long_axis(spark: SparkSession, root: str) -> DataFrame:
    return audit.monotonic(table(spark, root, "orders"), "o_orderkey", "o_totalprice", down=False, block=1000)


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS value, round(avg(p_retailprice), 6) + 1 AS anchor FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING min(p_partkey) % 2 = 0) GROUP BY p_brand")
def audit_release(spark: SparkSession, root: str) -> DataFrame:
    got = table(spark, root, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("value"), F.min("p_partkey").alias("k"))
    anchors = got.select("p_brand", F.when(F.col("k") % 2 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return audit.release(got.select("p_brand", "value"), anchors, ["p_brand"])


@query(
    f"""WITH {EVENTS}, f AS (SELECT YEAR, count(*) AS n FROM ev WHERE YEAR <> 1996 GROUP BY ALL), p AS (SELECT YEAR, count(*) + (YEAR = 1999)::INT AS n, (YEAR = 1997)::INT AS i FROM ev WHERE YEAR <> 2001 GROUP BY YEAR)
SELECT coalesce(f.YEAR, p.YEAR) AS YEAR, CASE WHEN f.n IS NULL THEN 'no file' WHEN p.n IS NULL THEN 'not reported' WHEN p.n <> f.n THEN 'row count' ELSE 'interpolated steps' END AS problem
FROM f FULL JOIN p ON f.YEAR = p.YEAR WHERE f.n IS NULL OR p.n IS NULL OR p.n <> f.n OR i <> 0"""
)
def audit_archive(spark: SparkSession, root: str) -> DataFrame:
    n = storm_events(spark, root).groupBy("YEAR").agg(F.count(F.lit(1)).alias("rows"))
    rep = n.where("YEAR <> 2001").select("YEAR", (F.col("rows") + (F.col("YEAR") == 1999).cast("int")).alias("rows"), (F.col("YEAR") == 1997).cast("int").alias("interpolated_times"))
    return audit.archive(n.where("YEAR <> 1996"), rep, {})


@query(f"WITH {EVENTS} SELECT YEAR, CASE WHEN YEAR >= 1999 THEN count(*) FILTER (BASIN = 'NA') ELSE count(*) END::BIGINT AS rows FROM ev GROUP BY YEAR")
def upsert_report(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root)
    count = lambda d: d.groupBy("YEAR").agg(F.count(F.lit(1)).alias("rows"))
    return report.upserted(count(ev), count(ev.where("BASIN = 'NA' AND YEAR >= 1999")))


@query(f"WITH {EVENTS} SELECT BASIN, CASE WHEN BASIN IN ('NA', 'WP') THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT BASIN FROM ev) WHERE BASIN IN ('NA', 'WP', 'SA')")
def value_sets(spark: SparkSession, root: str) -> DataFrame:
    ev = storm_events(spark, root)
    return audit.same_values(ev.where("BASIN <> 'SA'"), ev.where("BASIN NOT IN ('NA', 'WP')"), "BASIN")


@query(
    f"""WITH {CELLS}, {LOCAL}
SELECT (SELECT count(*) FROM ce WHERE SID = 'S3' AND TIME = TIMESTAMP '2024-01-02 03:00:00')::BIGINT AS wet_cells, count(*)::BIGINT AS extreme_cells, round(avg(PRECIP_3H_MM::DOUBLE), 6) AS mean FROM xc WHERE SID = 'S3' AND TIME = TIMESTAMP '2024-01-02 03:00:00'"""
)
def example_event(spark: SparkSession, root: str) -> DataFrame:
    return audit.example(extreme(spark, root), wet_samples(spark, root), "S3", "2024-01-02 03:00:00").select("wet_cells", "extreme_cells", *r("mean"))
