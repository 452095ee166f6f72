"""Checks of tables: each gives rows (check, failures), computed in one pass where one will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geo import grid_row, haversine_km, row_lat, row_lon, wrapped_delta
from ..functions.scalars import WET_MM_3H, units_accepted
from ..sources.files import GRID, GRID_TOLERANCE
from .events import ROWS, build_events
from .thresholds import WET_SAMPLE_RULE


def counted(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, failures: how many rows break each rule; a rule that gives null is broken."""
    one = df.agg(*(F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0)).cast("long").alias(k) for k, ok in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("failures")) for k in checks))).alias("x")).select("x.*")


def passed(report: DataFrame) -> bool:
    """Whether nothing failed; warnings do not count."""
    return report.where("failures > 0 AND NOT startswith(check, 'warning')").isEmpty()


def duplicates(df: DataFrame, keys: list[str], name: str = "duplicate keys") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.lit(name).alias("check"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("long").alias("failures"))


def columns_missing(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


# Columns that a track archive must have.
REQUIRED = ("SID", "SEASON", "BASIN", "NAME", "ISO_TIME", "LAT", "LON", "TRACK_TYPE", "USA_WIND", "USA_PRES")


def inputs(raw_tracks: DataFrame, names: DataFrame, listing: DataFrame) -> DataFrame:
    """Track bounds and duplicate (SID, TIME); files that the calendar misses, and those that it does not know."""
    t = counted(raw_tracks, {"latitude bounds": F.abs("LAT") <= 90, "longitude bounds": F.abs("LON") <= 360, "track time": F.col("TIME").isNotNull()})
    gone = names.join(listing.select("NAME"), "NAME", "left_anti").agg(F.lit("missing files").alias("check"), F.count(F.lit(1)).alias("failures"))
    extra = listing.join(names.select("NAME"), "NAME", "left_anti").agg(F.lit("extra files").alias("check"), F.count(F.lit(1)).alias("failures"))
    return t.unionByName(duplicates(raw_tracks, ["SID", "TIME"], "duplicate positions")).unionByName(gone).unionByName(extra)


def grid(axes: DataFrame, unit: str | None, shape: dict[str, tuple[int, float, float]] = GRID, tolerance: float = GRID_TOLERANCE) -> DataFrame:
    """check, failures of a field's axes, rows (AXIS, POS, VALUE), and its unit: sizes, directions, ends.

    Latitudes must fall and longitudes rise, both without a repeat.
    """
    w = W.partitionBy("AXIS").orderBy("POS")
    step = F.col("VALUE") - F.lag("VALUE").over(w)
    known = axes.where(F.col("AXIS").isin(*shape)).withColumn("_s", F.when(F.col("AXIS") == "lat", -step).otherwise(step))
    one = known.groupBy("AXIS").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") <= 0).alias("wrong"), F.min_by("VALUE", "POS").alias("a"), F.max_by("VALUE", "POS").alias("z"))
    per = one.groupBy().agg(*(F.max(F.when(F.col("AXIS") == k, F.col(c))).alias(f"{k}_{c}") for k in shape for c in ("n", "wrong", "a", "z")))
    checks = {}
    for k, (n, a, z) in shape.items():
        checks |= {f"{k} size": F.col(f"{k}_n") == n, f"{k} direction": F.col(f"{k}_wrong") == 0, f"{k} ends": (F.abs(F.col(f"{k}_a") - a) <= tolerance) & (F.abs(F.col(f"{k}_z") - z) <= tolerance)}
    return counted(per, checks | {"unit": units_accepted(F.lit(unit))})


def axis_summaries(axes: DataFrame) -> DataFrame:
    """NAME, AXIS, SIZE, FIRST, LAST, RISING, FALLING from axes' values (NAME, AXIS, POS, VALUE), as file headers give them."""
    w = W.partitionBy("NAME", "AXIS").orderBy("POS")
    t = axes.withColumn("_s", F.col("VALUE") - F.lag("VALUE").over(w))
    return t.groupBy("NAME", "AXIS").agg(F.count(F.lit(1)).cast("int").alias("SIZE"), F.min_by("VALUE", "POS").alias("FIRST"), F.max_by("VALUE", "POS").alias("LAST"), F.count_if(F.col("_s") > 0).cast("int").alias("RISING"), F.count_if(F.col("_s") < 0).cast("int").alias("FALLING"))


def archive_grids(headers: DataFrame, shape: dict[str, tuple[int, float, float]] = GRID, tolerance: float = GRID_TOLERANCE) -> DataFrame:
    """check, failures: how many files' axes break each rule; an archive is judged in one pass over its headers.

    Latitudes must fall and longitudes rise at every step, with the grid's sizes and ends; with a column UNIT, units
    are judged too (once a file, by its latitudes).
    """
    checks = {}
    for axis, (n, a, z) in shape.items():
        other = F.col("AXIS") != axis
        steps = F.col("FALLING") if axis == "lat" else F.col("RISING")
        checks |= {f"{axis} size": other | (F.col("SIZE") == n), f"{axis} direction": other | (steps == F.col("SIZE") - 1), f"{axis} ends": other | ((F.abs(F.col("FIRST") - a) <= tolerance) & (F.abs(F.col("LAST") - z) <= tolerance))}
    if "UNIT" in headers.columns:
        checks["unit"] = (F.col("AXIS") != "lat") | units_accepted("UNIT")
    return counted(headers, checks)


def monotonic(df: DataFrame, order: str, value: str, down: bool = True, block: float = 1 << 16) -> DataFrame:
    """check, failures: steps of a coordinate axis against its direction.

    Steps inside a block of `block` units of the order are judged in its own task, and those from one block to
    the next on the blocks' ends, a row for each; so no task holds the axis. A missing value is no step, as is a missing order.
    """
    own = df.where(F.col(order).isNotNull()).select(F.floor(F.col(order) / block).alias("_b"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    wrong = lambda s: F.coalesce(F.sum(F.when((s >= 0) if down else (s <= 0), 1)), F.lit(0))
    inside = own.withColumn("_s", F.col("_v") - F.lag("_v").over(W.partitionBy("_b").orderBy("_o"))).agg(wrong(F.col("_s")).alias("n"))
    ends = own.groupBy("_b").agg(F.min_by("_v", "_o").alias("_first"), F.max_by("_v", "_o").alias("_last"))
    between = ends.withColumn("_s", F.col("_first") - F.lag("_last").over(W.orderBy("_b"))).agg(wrong(F.col("_s")).alias("n"))
    return inside.unionByName(between).agg(F.lit("monotonic axis").alias("check"), F.sum("n").cast("long").alias("failures"))


def cells(attributed: DataFrame, interpolated_times: list[str] = (), year: int | None = None) -> DataFrame:
    """The cell table: no nulls, wet strictly, amounts three times the rates, coordinates of the rows, provenance flags, years of the times.

    year: the table must be of that year alone and not empty, and a warning counts 1 if it has no North Atlantic rows.
    """
    names = [F.lit(t).cast("timestamp") for t in interpolated_times]
    flagged = F.col("TIME").isin(*names) if names else F.lit(False)
    lon, p = F.col("GRID_LON"), F.col("PRECIP_3H_MM").cast("double")
    own = F.year("TIME") == F.col("YEAR")
    checks = {f"null {c}": F.col(c).isNotNull() for c in attributed.columns}
    checks |= {
        "wet": F.col("PRECIP_3H_MM") > F.lit(WET_MM_3H).cast("float"),
        "rate": F.abs(F.try_divide(p, F.col("PRECIP_MMHR").cast("double")) - 3) <= 1e-5,
        "cell latitude": F.abs(F.col("GRID_LAT") - row_lat("ROW")) <= 3e-4,
        "cell longitude": (F.abs(lon - row_lon("ROW")) <= 3e-4) & (lon >= 0) & (lon < 360),
        "storm longitude": (F.col("TC_LON_360") >= 0) & (F.col("TC_LON_360") < 360),
        "flag": F.col("IS_INTERPOLATED_TIMESTEP") == flagged,
        "year": own if year is None else own & (F.col("YEAR") == year),
    }
    if year is None:
        return counted(attributed, checks)
    whole = attributed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("BASIN") == "NA").alias("na"))
    return counted(attributed, checks).unionByName(counted(whole, {"not empty": F.col("n") > 0, "warning: no North Atlantic": F.col("na") > 0}))


def cell_summary(attributed: DataFrame) -> DataFrame:
    """One row a year: rows, distinct storms, times and basins, extremes of precipitation."""
    return attributed.groupBy("YEAR").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("SID").alias("storms"), F.countDistinct("TIME").alias("times"), F.array_sort(F.collect_set("BASIN")).alias("basins"),
        F.min("PRECIP_3H_MM").alias("least"), F.max("PRECIP_3H_MM").alias("most"), F.sum(F.col("IS_INTERPOLATED_TIMESTEP").cast("long")).alias("interpolated"),
    )


def boundary(attributed: DataFrame) -> DataFrame:
    """One row a time step: cells, greatest distance and relative longitude, row round trips, seams crossed, and the step from the last."""
    t = attributed.withColumn("_d", haversine_km("TC_LAT", "TC_LON_360", "GRID_LAT", "GRID_LON")).withColumn("_r", wrapped_delta("GRID_LON", "TC_LON_360"))
    g = t.groupBy("SID", "TIME").agg(
        F.count(F.lit(1)).alias("cells"), F.max("_d").alias("max_km"), F.max(F.abs("_r")).alias("max_dlon"),
        F.sum((grid_row("GRID_LAT", "GRID_LON") != F.col("ROW")).cast("long")).alias("bad_rows"),
        (F.max(F.col("GRID_LON")) - F.min(F.col("GRID_LON")) > 180).alias("crosses_zero"),
        (F.max((F.col("GRID_LON") < 180).cast("int")) + F.max((F.col("GRID_LON") >= 180).cast("int")) == 2).alias("crosses_180"),
        F.min("TC_LON_360").alias("_lon"),
    )
    step = wrapped_delta("_lon", F.lag("_lon").over(W.partitionBy("SID").orderBy("TIME")))
    return g.withColumn("step_dlon", step).drop("_lon")


def boundary_checks(attributed: DataFrame, storm: str, hemi: str, cross_180: bool = False, cross_zero: bool = False, most_km: float = 1000.01, most_dlon: float = 170.0, most_step: float = 10.0) -> DataFrame:
    """check, failures of one storm's cells: its name and hemisphere, row round trips, distances, relative longitudes.

    cross_180, cross_zero: the storm's own longitudes must lie on both sides of 180, or within 5 degrees of
    either side of 0, and then no step between its times may be longer than `most_step`.
    """
    sign = F.col("TC_LAT") > 0 if hemi == "NH" else F.col("TC_LAT") < 0
    rows = counted(attributed, {
        "storm": F.col("SID") == storm, "hemisphere": sign, "row round trip": grid_row("GRID_LAT", "GRID_LON") == F.col("ROW"),
        "distance": haversine_km("TC_LAT", "TC_LON_360", "GRID_LAT", "GRID_LON") <= most_km, "relative longitude": F.abs(wrapped_delta("GRID_LON", "TC_LON_360")) <= most_dlon,
    })
    times = attributed.where(F.col("SID") == storm).groupBy("TIME").agg(F.min("TC_LON_360").cast("double").alias("_lon"))
    step = wrapped_delta("_lon", F.lag("_lon").over(W.orderBy("TIME")))  # the times of one storm
    s = times.withColumn("_s", F.abs(step)).agg(F.count(F.lit(1)).alias("n"), F.min("_lon").alias("lo"), F.max("_lon").alias("hi"), F.count_if(F.col("_s") > most_step).alias("jumps"))
    checks = {"not empty": F.col("n") > 0}
    if cross_180:
        checks["crosses 180"] = (F.col("lo") < 180) & (F.col("hi") >= 180)
    if cross_zero:
        checks["crosses 0"] = (F.col("lo") < 5) & (F.col("hi") > 355)
    if cross_180 or cross_zero:
        checks["steps"] = F.col("jumps") == 0
    return rows.unionByName(counted(s, checks))


def archive(files: DataFrame, report: DataFrame, interpolated: dict[int, int]) -> DataFrame:
    """YEAR, problem for each year whose file, rows or interpolated steps are not as reported.

    files: YEAR, rows; report: YEAR, rows, interpolated_times; interpolated: steps by year (others 0).
    """
    j = files.select("YEAR", F.col("rows").alias("file_rows")).join(report.select("YEAR", "rows", "interpolated_times"), "YEAR", "full_outer")
    want = F.lit(0)
    for y, k in interpolated.items():
        want = F.when(F.col("YEAR") == y, k).otherwise(want)
    problem = F.when(F.col("file_rows").isNull(), "no file").when(F.col("rows").isNull(), "not reported").when(F.col("rows") != F.col("file_rows"), "row count").when(F.col("interpolated_times") != want, "interpolated steps")
    return j.select("YEAR", problem.alias("problem")).where("problem IS NOT NULL")


def thresholds(t: DataFrame, value: str = "POT99_MM_3H", top: float = 120.0, exact_cells: int | None = None) -> DataFrame:
    """Unique rows of the grid, finite values above the wet limit, counts, the sample rule, exact cells just where the
    bins end, and as many of them as expected."""
    v = F.col(value)
    is_exact = F.col("IS_EXACT_TAIL_REFINEMENT")
    checks = {"finite": ~F.isnan(v) & (v < float("inf")) & (v > F.lit(WET_MM_3H).cast("float")), "count": F.col("N_WET") > 0, "exact above the bins": is_exact == (v > top), "row": (F.col("ROW") >= 0) & (F.col("ROW") < ROWS)}
    if "WET_SAMPLE_RULE" in t.columns:
        checks["wet sample rule"] = F.col("WET_SAMPLE_RULE") == WET_SAMPLE_RULE
    out = counted(t, checks).unionByName(duplicates(t, ["ROW"]))
    if exact_cells is None:
        return out
    return out.unionByName(counted(t.agg(F.count_if(is_exact).alias("n")), {"exact cells": F.col("n") == exact_cells}))


def reaggregated(events: DataFrame, extreme: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """SID, TIME, problem: events against events built anew from their cells, both ways.

    Sides: missing, extra; else a different count, flag, or mean beyond the tolerance (relative and absolute).
    """
    new = build_events(extreme).select("SID", "TIME", F.col("EVENT_INTENSITY_MM_3H").alias("_m"), F.col("N_EXTREME_CELLS").alias("_n"), F.col("IS_INTERPOLATED_TIMESTEP").alias("_f"))
    j = events.join(new, ["SID", "TIME"], "full_outer")
    m = F.col("EVENT_INTENSITY_MM_3H")
    far = F.abs(m - F.col("_m")) > tolerance + tolerance * F.abs(F.col("_m"))
    problem = F.when(m.isNull(), "missing").when(F.col("_m").isNull(), "extra").when(F.col("N_EXTREME_CELLS") != F.col("_n"), "count").when(far, "mean").when(F.col("IS_INTERPOLATED_TIMESTEP") != F.col("_f"), "flag")
    return j.select("SID", "TIME", problem.alias("problem")).where("problem IS NOT NULL")


def margins(extreme: DataFrame, precip: str = "PRECIP_3H_MM", value: str = "POT99_MM_3H") -> DataFrame:
    return counted(extreme, {"margin above the threshold": F.col(precip) > F.col(value)})


def same_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of a column that only one side has."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def example(extreme: DataFrame, wet: DataFrame, sid: str, time: str) -> DataFrame:
    """wet_cells, extreme_cells, mean of one storm's time step; the filters reach the files."""
    at = lambda df: df.where((F.col("SID") == sid) & (F.col("TIME") == F.lit(time).cast("timestamp")))
    w = at(wet).agg(F.count(F.lit(1)).alias("wet_cells"))
    return w.crossJoin(at(extreme).agg(F.count(F.lit(1)).alias("extreme_cells"), F.avg(F.col("PRECIP_3H_MM").cast("double")).alias("mean")))


def release(computed: DataFrame, anchors: DataFrame, keys: list[str], tolerance: float = 1e-10) -> DataFrame:
    """keys, value, anchor of published numbers that are not met, or are missing."""
    j = anchors.withColumnRenamed("value", "anchor").join(computed, keys, "left")
    ok = F.abs(F.col("value") - F.col("anchor")) <= tolerance + tolerance * F.abs("anchor")
    return j.where(~F.coalesce(ok, F.lit(False))).select(*keys, "value", "anchor")
