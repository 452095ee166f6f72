"""Audits of a workflow's inputs and outputs, as reports (check, failures)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_key
from ..operators import audit, bootstrap, fields
from ..sources import files
from . import figures
from .workflow import Settings, bootstrap_settings

AUDITS = ("inputs", "cells", "thresholds", "events", "release")


def row(spark: SparkSession, check: str, failures: int) -> DataFrame:
    return spark.createDataFrame([(check, failures)], "check string, failures long")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inputs(spark: SparkSession, s: Settings) -> DataFrame:
    """Columns and bounds of the tracks, files that are missing or unknown, and axes and units in the files' headers."""
    raw = files.raw_tracks(spark, s.tracks_csv)
    gone = audit.columns_missing(raw, list(audit.REQUIRED))
    if gone:
        return row(spark, f"track columns ({', '.join(gone)})", len(gone))
    positions = raw.select("SID", F.try_to_timestamp("ISO_TIME").alias("TIME"), *(F.col(c).try_cast("double").alias(c) for c in ("LAT", "LON")))
    names = fields.calendar(spark, s.first, s.last).select("NAME")
    if not s.netcdf:
        known = spark.read.parquet(s.fields).select("TIME").distinct().select(file_key("TIME").alias("NAME"))
        return audit.inputs(positions, names, known)
    found = fields.index(files.listing(spark, s.fields), files.listing(spark, s.overrides) if s.overrides else None)
    paths = [r["PATH"] for r in found.join(names, "NAME").select("PATH").collect()]  # a path for each time step
    return audit.inputs(positions, names, found).unionByName(audit.archive_grids(files.headers(spark, paths, s.variable)))


def cells(spark: SparkSession, s: Settings) -> DataFrame:
    """The cell table in one pass, and years without cells. Replaced time steps are those that the override table marks."""
    table = spark.read.parquet(f"{s.work}/cells").where(F.col("YEAR").between(s.first, s.last))
    times: list[str] = []
    if s.overrides and not s.netcdf:
        marked = spark.read.parquet(s.overrides).where("IS_INTERPOLATED").select(F.date_format("TIME", "yyyy-MM-dd HH:mm:ss").alias("t")).distinct()
        times = [r["t"] for r in marked.collect()]  # the steps that were replaced by hand
    years = spark.range(s.first, s.last + 1).select(F.col("id").cast("int").alias("YEAR"))
    none = years.join(table.select(F.col("YEAR").cast("int").alias("YEAR")).distinct(), "YEAR", "left_anti").agg(F.lit("years without cells").alias("check"), F.count(F.lit(1)).alias("failures"))
    return audit.cells(table, times).unionByName(none)


def thresholds(spark: SparkSession, s: Settings) -> DataFrame:
    return audit.thresholds(spark.read.parquet(f"{s.work}/thresholds"))


def events(spark: SparkSession, s: Settings) -> DataFrame:
    """Events against their cells, by kind of difference, and cells against their thresholds."""
    made, extreme = (files.annual(spark, f"{s.work}/{n}", s.first, s.last) for n in ("events", "extreme_cells"))
    found = audit.reaggregated(made, extreme).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    kinds = spark.createDataFrame([(k,) for k in ("missing", "extra", "count", "mean", "flag")], "problem string")
    told = kinds.join(found, "problem", "left").select(F.concat(F.lit("event "), "problem").alias("check"), F.coalesce("n", F.lit(0)).alias("failures"))
    return told.unionByName(audit.margins(extreme))


def release(spark: SparkSession, s: Settings) -> DataFrame:
    """Published numbers, and digests of source files, against what is saved.

    expected: a JSON document with events, valid_map_cells, significant_map_cells,
    global_and_hemisphere_trends and latitude_trends; and, if it likes, sources (path below the working
    folder, sha256). With `intervals`, the components' intervals are made anew and compared too.
    """
    expected = files.json_table(spark, s.expected).first().asDict(recursive=True)
    saved = lambda n: spark.read.parquet(f"{s.work}/{n}")
    parts, trends = saved("analysis/components"), saved("analysis/component_trends")
    surfaces = saved("tables/S3A_surfaces").withColumnRenamed("mk_p", "p_value") if "surface" in s.sections and s.land else None
    numbers = figures.verification(saved("figures/annual_series"), parts, trends, saved("tables/S1C_baselines"), saved("events"), saved("figures/spatial_trends"), saved("figures/latitude_series"), saved("tables/S2_basins"), surfaces, expected)
    out = [numbers.select("check", F.when(F.col("passed"), 0).otherwise(1).cast("long").alias("failures"))]
    if expected.get("sources"):
        want = spark.createDataFrame([(x["path"], x["sha256"]) for x in expected["sources"]], "file string, want string")
        have = files.digests(spark, s.work).select("PATH", "SHA256")
        same = have.join(want, F.endswith("PATH", F.concat(F.lit("/"), "file")) & (F.col("SHA256") == F.col("want")), "right")
        out.append(same.groupBy("file").agg(F.max((F.col("SHA256").isNotNull()).cast("int")).alias("ok")).select(F.concat(F.lit("sha256 "), "file").alias("check"), (1 - F.col("ok")).cast("long").alias("failures")))
    if s.intervals:
        again = bootstrap.component_intervals(parts, ["HEMISPHERE"], **bootstrap_settings(s))
        both = trends.alias("a").join(again.alias("b"), ["HEMISPHERE", "COMPONENT"], "left")
        near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-10 + 1e-10 * F.abs(F.col(f"b.{c}"))
        out.append(audit.counted(both, {"component intervals": near("ci_low") & near("ci_high")}))
    return union(out)


def report(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    """An audit's report, kept below the working folder and read back."""
    if name not in AUDITS:
        raise ValueError(f"no audit {name}")
    made = {"inputs": inputs, "cells": cells, "thresholds": thresholds, "events": events, "release": release}[name](spark, s)
    made.coalesce(1).write.mode("overwrite").parquet(f"{s.work}/audits/{name}")
    return spark.read.parquet(f"{s.work}/audits/{name}")
