"""Tables behind figures and supplements, from events, cells, tracks and band tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BASIN_HEMISPHERE, BASIN_NAMES
from ..operators import bands, bootstrap, decompose, dist, report, trend
from ..operators.keys import join_by

VALUE = bands.VALUE


def fitted(series: DataFrame, keys: Sequence[str], y: str, **how) -> DataFrame:
    """`series` (keys, YEAR, y, ...) with fit, fit_lower, fit_upper, slope by decade and p_value."""
    keys = list(keys)
    lines = bootstrap.fit_bands(series, keys, y, **how)
    return join_by(join_by(series, lines, [*keys, "YEAR"]), trend.trends(series, keys, y).drop("n"), keys)


def annual_series(events: DataFrame, years: tuple[int, int], **how) -> DataFrame:
    """domain, YEAR, n, mean, fit, fit_lower, fit_upper, slope, p_value of all events and of each hemisphere."""
    return fitted(bands.annual_means(events, years=years), ["domain"], "mean", **how)


def spatial_trends(cells: DataFrame, value: str = "PRECIP_3H_MM", lat: str = "GRID_LAT", lon: str = "GRID_LON", least_years: int = 10) -> DataFrame:
    """lat, lon, trend, p_value, valid_years of 1-degree cells."""
    t = trend.trends(bands.degree_cell_means(cells, value, lat, lon, least_years), ["lat", "lon"], "mean")
    return t.select("lat", "lon", F.col("slope").alias("trend"), "p_value", F.col("n").alias("valid_years"))


def samples(events: DataFrame, value: str = VALUE) -> DataFrame:
    """HEMISPHERE, BAND, BAND_LABEL and the intensity of every event."""
    rows = events.select("HEMISPHERE", bands.band("TC_LAT", "HEMISPHERE").alias("BAND"), F.col(value).cast("double").alias(value))
    return bands.labelled(rows)


def band_quantiles(events: DataFrame, value: str = VALUE) -> DataFrame:
    """HEMISPHERE, BAND, q10, q50, q90, q99."""
    return dist.quantiles(samples(events, value), ["HEMISPHERE", "BAND"], value)


def latitude_series(tracks: DataFrame, events: DataFrame, years: tuple[int, int], **how) -> DataFrame:
    """record_type, domain, YEAR, mean_lat, n_records with the Sen line, its interval, slope and p_value."""
    return fitted(bands.mean_latitude(tracks, events, years), ["record_type", "domain"], "mean_lat", **how)


def surface_series(surface: DataFrame, **how) -> DataFrame:
    """HEMISPHERE, SURFACE, YEAR, N_t, mean with the Sen line, its interval, slope and p_value."""
    keys = ["HEMISPHERE", "SURFACE"]
    return fitted(decompose.annual_series(surface, keys, "n_j", "vol_j"), keys, "mean", **how)


def surface_terms(surface: DataFrame) -> DataFrame:
    """HEMISPHERE, SURFACE, BAND, BAND_LABEL, migration, intensity, residual, total."""
    return bands.labelled(decompose.band_terms(surface, ["HEMISPHERE", "SURFACE"], "n_j", "vol_j"))


def baselines(annual: DataFrame, events: DataFrame, value: str = VALUE) -> DataFrame:
    """HEMISPHERE, BAND, BAND_LABEL, climatological_mean (of annual means), pooled_median, n_events (0 where there are none)."""
    keys = ["HEMISPHERE", "BAND"]
    means = annual.groupBy(*keys).agg(F.avg("MEAN_INTENSITY").alias("climatological_mean"))
    pooled = samples(events, value).groupBy(*keys).agg(F.median(value).alias("pooled_median"), F.count(F.lit(1)).alias("n_events"))
    out = means.join(pooled, keys, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return bands.labelled(out)


def basin_terms(terms: DataFrame, events: DataFrame) -> DataFrame:
    """`terms` of the basins with n_events; without events the estimates are null."""
    counts = bands.basin_band_counts(events).withColumnRenamed("BASIN", "domain")
    numbers = [c for c in terms.columns if c.endswith(("_point", "_ci_low", "_ci_high"))]
    return decompose.masked(terms.where(F.col("domain").isin(*BASIN_HEMISPHERE)), counts, ["domain", "BAND"], numbers)


def compact(terms: DataFrame, names: dict[str, str]) -> DataFrame:
    """domain, band_0..band_3: a row of the printed table for each domain, by the name that is shown."""
    shown = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("domain"))
    return report.compact(terms.where(F.col("domain").isin(*names)), ["domain"]).withColumn("domain", shown)


HEMISPHERES = {"NH": "Northern Hemisphere", "SH": "Southern Hemisphere"}


def table_1(terms: DataFrame) -> DataFrame:
    return compact(terms, HEMISPHERES)


def table_2(terms: DataFrame, events: DataFrame) -> DataFrame:
    return compact(basin_terms(terms, events), BASIN_NAMES)


def surface_components(surface: DataFrame) -> DataFrame:
    """HEMISPHERE, SURFACE, YEAR and the terms of the annual mean."""
    return decompose.components(surface, ["HEMISPHERE", "SURFACE"], "n_j", "vol_j", strict=False)


def table_3(surface: DataFrame) -> DataFrame:
    """HEMISPHERE, SURFACE, total, mk_p, redistribution, within_band, interaction: slopes by decade, and the total's p-value."""
    keys = ["HEMISPHERE", "SURFACE"]
    t = decompose.component_trends(surface_components(surface), keys)
    pick = lambda name, c, out: F.max(F.when(F.col("COMPONENT") == name, F.col(c))).alias(out)
    return t.groupBy(*keys).agg(pick("TOTAL", "slope", "total"), pick("TOTAL", "p_value", "mk_p"), *(pick(n, "slope", n.lower()) for n in ("REDISTRIBUTION", "WITHIN_BAND", "INTERACTION")))


def verification(series: DataFrame, parts: DataFrame, saved_trends: DataFrame, base: DataFrame, events: DataFrame, spatial: DataFrame, latitudes: DataFrame, basins: DataFrame, surfaces: DataFrame | None, expected: dict) -> DataFrame:
    """check, passed: the published numbers against the tables, as one report.

    expected: events, valid_map_cells, significant_map_cells, and trends as rows (domain[, record_type],
    trend_per_decade, p_value). Numbers agree within 1e-10, relative and absolute.
    """
    spark = series.sparkSession
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-10 + 1e-10 * F.abs(b), a.isNull() & b.isNull())

    def against(found: DataFrame, keys: list[str], rows: list[dict], name: str) -> list[DataFrame]:
        kinds = ", ".join(f"{k} string" for k in keys) + ", trend double, p double"
        want = spark.createDataFrame([(*(r[k] for k in keys), float(r["trend_per_decade"]), float(r["p_value"])) for r in rows], kinds)
        j = want.join(found, keys, "left")
        label = lambda what: F.concat_ws(" ", *map(F.col, keys), F.lit(f"{name} {what}")).alias("check")
        ok = lambda a, b: F.coalesce(near(F.col(a), F.col(b)), F.lit(False)).alias("passed")
        return [j.select(label("slope"), ok("slope", "trend")), j.select(label("p"), ok("p_value", "p"))]

    def one(name: str, df: DataFrame, ok) -> DataFrame:
        return df.agg(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"))

    again = decompose.component_trends(parts, ["HEMISPHERE"]).select("HEMISPHERE", "COMPONENT", F.col("slope").alias("_s"))
    pooled = samples(events).groupBy("HEMISPHERE", "BAND").agg(F.median(VALUE).alias("_m"), F.count(F.lit(1)).alias("_n"))
    medians = base.join(pooled, ["HEMISPHERE", "BAND"], "left")
    empty = basins.where("domain = 'NI' AND BAND = 3")
    nulls = [c for c in basins.columns if c.endswith("_point")]
    out = [
        *against(trend.trends(series, ["domain"], "mean"), ["domain"], expected["global_and_hemisphere_trends"], "series"),
        *against(trend.trends(latitudes, ["record_type", "domain"], "mean_lat"), ["record_type", "domain"], expected["latitude_trends"], "latitude"),
        one("annual closure", parts, F.max(F.abs("CLOSURE_ERROR")) <= 1e-10),
        one("component slopes", saved_trends.join(again, ["HEMISPHERE", "COMPONENT"], "left"), F.min(F.coalesce(near(F.col("slope"), F.col("_s")), F.lit(False)))),
        one("event count", base, F.sum("n_events") == expected["events"]),
        one("band medians", medians, F.min(near(F.col("pooled_median"), F.col("_m")))),
        one("band counts", medians, F.min(F.col("n_events") == F.coalesce("_n", F.lit(0)))),
        one("map cells", spatial, F.count(F.lit(1)) == expected["valid_map_cells"]),
        one("significant map cells", spatial, F.count_if(F.col("p_value") < 0.05) == expected["significant_map_cells"]),
        one("empty band", empty, (F.count(F.lit(1)) == 1) & (F.sum("n_events") == 0) & F.min(~F.exists(F.array(*(F.col(c).isNotNull() for c in nulls)), lambda x: x))),
    ]
    if surfaces is not None:
        out.append(one("surface trends are not significant", surfaces, F.min(F.col("p_value")) > 0.05))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole

