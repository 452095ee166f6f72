"""The workflow: tracks, cells, histograms, thresholds, events, analysis, figures, tables. Stages read and write tables below one folder.

Each stage is one lazily composed plan over all its years; YEAR is a partition column, so a range of years
reads and replaces just its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import row_lat, row_lon
from ..functions.scalars import is_wet
from ..operators import audit, bands, bootstrap, decompose, events, features, fields, report, thresholds, tracks, trend
from ..session import ship
from ..sources import files
from . import figures

#: A stage of its own, before all others, for an archive with gaps.
REPLACE = "replace"
STAGES = ("tracks", "cells", "histograms", "thresholds", "events", "analysis", "figures", "tables")
SECTIONS = ("global", "decomposition", "distributions", "surface")


@dataclass(frozen=True)
class Settings:
    work: str
    tracks_csv: str = ""
    fields: str = ""
    overrides: str = ""
    first: int = 1980
    last: int = 2023
    outer_km: float = features.OUTER_KM
    centre_km: float = features.CENTRE_KM
    repetitions: int = bootstrap.REPETITIONS
    block_years: int = bootstrap.BLOCK_YEARS
    seed: int = bootstrap.SEED
    overwrite: bool = False
    storms: tuple[str, ...] = ()
    max_times: int | None = None
    start_time: str = ""
    end_time: str = ""
    netcdf: bool = False  # fields and overrides are folders of NetCDF files
    variable: str = "precipitation"
    partial: bool = False  # the archive may lack time steps
    land: str = ""  # a table of the rows on land, for the surface section
    sections: tuple[str, ...] = SECTIONS
    expected: str = ""  # a JSON document of published numbers, for the release's audit
    resume: bool = False  # histograms of years that are there stay
    intervals: bool = False  # that audit makes bootstrap intervals anew


def _mode(s: Settings) -> str:
    return "overwrite" if s.overwrite else "errorifexists"


def field_table(spark: SparkSession, s: Settings) -> DataFrame:
    """Fields of the years, with the time steps of the override table in place of the source's.

    The years are a range of TIME, so that other row groups are not read. A time step that is missing is an
    error, unless the archive is said to be partial.
    """
    calendar = fields.calendar(spark, s.first, s.last)
    if s.netcdf:
        listing, new = (files.listing(spark, p) if p else None for p in (s.fields, s.overrides))
        index = fields.index(listing, new).join(calendar.select("NAME"), "NAME") if s.partial else fields.complete_index(calendar, listing, new)
        ship(spark)
        spark.dataSource.register(files.FieldSource)
        paths = "\n".join(sorted(r["PATH"] for r in index.collect()))  # a path for each time step
        return spark.read.format(files.FieldSource.name()).option("variable", s.variable).option("paths", paths).load()
    first, last = (F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp") for y in (s.first, s.last + 1))
    inside = (F.col("TIME") >= first) & (F.col("TIME") < last)
    f = spark.read.parquet(s.fields).where(inside)
    if s.overrides:
        f = fields.overridden(f, spark.read.parquet(s.overrides).where(inside))
    if not s.partial:
        complete(calendar, f)
    return f


def complete(calendar: DataFrame, f: DataFrame) -> None:
    """An error if a step of the calendar has no field."""
    gone = calendar.select("TIME", "NAME").join(f.select("TIME").distinct(), "TIME", "left_anti")
    names = [r["NAME"] for r in gone.orderBy("NAME").limit(5).collect()]
    if names:
        raise FileNotFoundError(f"fields are missing, such as {names}")


def run_replace(spark: SparkSession, s: Settings) -> None:
    """Replacements of all missing time steps, and where they come from, below `replaced`; `--overrides` takes the first.

    The archive is Parquet and is read without its checks: its times, and the fields around gaps. A gap at an end
    of the period has no two neighbours and is an error.
    """
    if s.netcdf:
        raise ValueError("replacements are made of long Parquet fields")
    all_fields = spark.read.parquet(s.fields).select("TIME", "ROW", "PRECIP_3H_MM")
    plan = fields.gaps(fields.calendar(spark, s.first, s.last), all_fields)
    fields.provenance(plan).coalesce(1).write.mode(_mode(s)).parquet(f"{s.work}/replaced/provenance")
    kept = spark.read.parquet(f"{s.work}/replaced/provenance").join(plan, "TIME").select("TIME", "BEFORE", "AFTER")
    fields.replacements(all_fields, kept).repartition("TIME").sortWithinPartitions("TIME", "ROW").write.mode(_mode(s)).parquet(f"{s.work}/replaced/fields")


def run_tracks(spark: SparkSession, s: Settings) -> None:
    raw = files.raw_tracks(spark, s.tracks_csv)
    if gone := audit.columns_missing(raw, list(audit.REQUIRED)):
        raise ValueError(f"the track archive has no columns {gone}")
    tracks.prepare(raw, s.first, s.last).write.mode(_mode(s)).parquet(f"{s.work}/tracks")


def run_cells(spark: SparkSession, s: Settings) -> None:
    t = tracks.within(spark.read.parquet(f"{s.work}/tracks"), list(s.storms), s.start_time or None, s.end_time or None, s.max_times)
    files.write_annual(features.attributed(t, field_table(spark, s), s.outer_km, s.centre_km), f"{s.work}/cells", s.overwrite)


def run_histograms(spark: SparkSession, s: Settings) -> None:
    """A year's histogram is its own partition: years can be added or made anew one by one.

    resume: years that are there stay as they are, and the others follow in order, each in a write of its own, so
    that a run that ended early goes on where it stopped. What is there must be the first years of the period.
    """
    if not s.resume:
        _write_histograms(spark, s, s.overwrite)
        return
    have = files.years(spark, f"{s.work}/histograms")
    inside = [y for y in have if s.first <= y <= s.last]
    if inside != list(range(s.first, s.first + len(inside))):
        raise ValueError(f"histograms of {inside} are not the first years from {s.first} on")
    for y in range(s.first + len(inside), s.last + 1):
        _write_histograms(spark, replace(s, first=y, last=y), False)


def _write_histograms(spark: SparkSession, s: Settings, overwrite: bool) -> None:
    f = field_table(spark, s).withColumn("YEAR", F.year("TIME"))
    f = f.where(F.col("PRECIP_3H_MM") > 0.3)  # plain, so that dry row groups are skipped; a little less strict than what follows
    h = f.where(is_wet("PRECIP_3H_MM")).groupBy("YEAR", "ROW", thresholds.bin_of(F.col("PRECIP_3H_MM")).alias("BIN")).agg(F.count(F.lit(1)).alias("N"))
    files.write_annual(h, f"{s.work}/histograms", overwrite)


def run_thresholds(spark: SparkSession, s: Settings) -> None:
    yearly = files.annual(spark, f"{s.work}/histograms", s.first, s.last)  # an error if a year is missing
    yearly.groupBy("YEAR").agg(F.sum("N").alias("N")).write.mode(_mode(s)).parquet(f"{s.work}/merged_years")
    hist = thresholds.merged(yearly)
    name = F.create_map(*(F.lit(x) for kv in thresholds.METHODS.items() for x in kv))
    t = thresholds.refined(field_table(spark, s), "PRECIP_3H_MM", hist=hist)
    t = t.select(
        "ROW", row_lat("ROW").cast("float").alias("GRID_LAT"), row_lon("ROW").cast("float").alias("GRID_LON"), "N_WET", F.col("POT99").alias("POT99_MM_3H"), F.element_at(name, F.col("THRESHOLD_METHOD")).alias("THRESHOLD_METHOD"),
        (F.col("THRESHOLD_METHOD") == "exact").alias("IS_EXACT_TAIL_REFINEMENT"), F.lit(thresholds.WET_SAMPLE_RULE).alias("WET_SAMPLE_RULE"),
        F.lit(thresholds.QUANTILE_METHOD).alias("QUANTILE_METHOD"), F.lit((thresholds.HIGH - thresholds.LOW) / thresholds.BINS).cast("float").alias("BIN_WIDTH_MM_3H"),
    )
    t.write.mode(_mode(s)).parquet(f"{s.work}/thresholds")


def run_events(spark: SparkSession, s: Settings) -> None:
    cells = files.annual(spark, f"{s.work}/cells", s.first, s.last)
    extreme = events.extreme_cells(cells, events.checked_thresholds(spark.read.parquet(f"{s.work}/thresholds")))
    files.write_annual(extreme, f"{s.work}/extreme_cells", s.overwrite)
    files.write_annual(events.build_events(files.annual(spark, f"{s.work}/extreme_cells", s.first, s.last)), f"{s.work}/events", s.overwrite)


def run_analysis(spark: SparkSession, s: Settings) -> None:
    """Annual bands, components, their trends and intervals, band terms by domain, annual series."""
    ev = files.annual(spark, f"{s.work}/events", s.first, s.last)
    years, how = (s.first, s.last), bootstrap_settings(s)
    hemi = bands.annual_bands(ev, ["HEMISPHERE"], years)
    parts = decompose.components(hemi, ["HEMISPHERE"])
    wide = bands.annual_bands(bands.basin_domains(ev), ["domain"], years, hemi="domain_hemisphere", strict=False)
    series = bands.annual_means(ev, years=years)
    out = {
        "annual_bands": bands.labelled(hemi),
        "components": parts,
        "component_trends": decompose.significance(decompose.component_trends(parts, ["HEMISPHERE"]), bootstrap.component_intervals(parts, ["HEMISPHERE"], **how), ["HEMISPHERE", "COMPONENT"]),
        "confidence_band": bootstrap.fit_bands(parts, ["HEMISPHERE"], "ANNUAL_MEAN", joint=False, **how),
        "band_terms": bootstrap.band_intervals(wide, ["domain"], **how),
        "domain_fit": bootstrap.mean_fit_bands(wide, ["domain"], **how),
        "annual_series": series.join(trend.trends(series, ["domain"], "mean").drop("n"), "domain"),
        "basin_band_counts": bands.basin_band_counts(ev),
    }
    for name, df in out.items():
        df.write.mode(_mode(s)).parquet(f"{s.work}/analysis/{name}")


def bootstrap_settings(s: Settings) -> dict:
    return {"block": s.block_years, "repetitions": s.repetitions, "seed": s.seed}


def _saved(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return spark.read.parquet(f"{s.work}/{name}")


def _surface(spark: SparkSession, s: Settings) -> DataFrame:
    return _saved(spark, s, "figures/surface_bands")


def run_figures(spark: SparkSession, s: Settings) -> None:
    """Tables behind the figures, by section; the surface section needs the rows on land."""
    if unknown := set(s.sections) - set(SECTIONS):
        raise ValueError(f"no sections {sorted(unknown)}")
    years = (s.first, s.last)
    ev = files.annual(spark, f"{s.work}/events", *years)
    x = files.annual(spark, f"{s.work}/extreme_cells", *years)
    out: dict[str, DataFrame] = {}
    if "global" in s.sections:
        out |= {"annual_series": figures.annual_series(ev, years, **bootstrap_settings(s)), "spatial_trends": figures.spatial_trends(x)}
    if "decomposition" in s.sections:
        out |= {n: _saved(spark, s, f"analysis/{n}") for n in ("band_terms", "domain_fit")}
    if "distributions" in s.sections:
        out |= {"samples": figures.samples(ev), "band_quantiles": figures.band_quantiles(ev), "latitude_series": figures.latitude_series(_saved(spark, s, "tracks"), ev, years, **bootstrap_settings(s))}
    out["event_counts"] = bands.basin_band_counts(ev)
    for name, df in out.items():
        df.write.mode(_mode(s)).parquet(f"{s.work}/figures/{name}")
    if "surface" in s.sections and s.land:
        cells = bands.with_surface(x, spark.read.parquet(s.land))
        bands.labelled(bands.surface_bands(cells, years, "PRECIP_3H_MM")).write.mode(_mode(s)).parquet(f"{s.work}/figures/surface_bands")
        for name, df in (("surface_series", figures.surface_series(_surface(spark, s), **bootstrap_settings(s))), ("surface_terms", figures.surface_terms(_surface(spark, s)))):
            df.write.mode(_mode(s)).parquet(f"{s.work}/figures/{name}")


def run_tables(spark: SparkSession, s: Settings) -> None:
    """Supplementary tables: full ones as Parquet and CSV, the printed ones as Markdown too."""
    ev = files.annual(spark, f"{s.work}/events", s.first, s.last)
    terms = _saved(spark, s, "analysis/band_terms")
    out = {
        "S1A_components": _saved(spark, s, "analysis/component_trends"),
        "S1B_bands": terms.where(F.col("domain").isin(*figures.HEMISPHERES)),
        "S1C_baselines": figures.baselines(_saved(spark, s, "analysis/annual_bands"), ev),
        "S2_basins": figures.basin_terms(terms, ev),
        "S1": figures.table_1(terms),
        "S2": figures.table_2(terms, ev),
    }
    if "surface" in s.sections and s.land:
        out |= {"S3A_surfaces": figures.table_3(_surface(spark, s)), "S3B_surface_bands": _saved(spark, s, "figures/surface_terms"), "S3_series": figures.surface_components(_surface(spark, s))}
    for name, df in out.items():
        df.write.mode(_mode(s)).parquet(f"{s.work}/tables/{name}")
        files.write_csv(_saved(spark, s, f"tables/{name}").coalesce(1), f"{s.work}/tables/{name}_csv", s.overwrite)
    for name in ("S1", "S2"):
        text = report.markdown(_saved(spark, s, f"tables/{name}"), ["domain"])  # a row for each hemisphere or basin
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(_mode(s)).text(f"{s.work}/tables/{name}_markdown")


def run(spark: SparkSession, s: Settings, stage: str = "all") -> None:
    """One stage, or all in order; a stage that fails stops the rest."""
    if stage not in (*STAGES, REPLACE, "all"):
        raise ValueError(f"no stage {stage}")
    if s.first > s.last:
        raise ValueError("the first year is after the last")
    by_name = {REPLACE: run_replace, "tracks": run_tracks, "cells": run_cells, "histograms": run_histograms, "thresholds": run_thresholds, "events": run_events, "analysis": run_analysis, "figures": run_figures, "tables": run_tables}
    if stage == "all" and not s.partial and not s.netcdf:
        field_table(spark, s)  # the archive's times are read once, and before anything is written
        s = replace(s, partial=True)
    for name in STAGES if stage == "all" else (stage,):
        by_name[name](spark, s)
