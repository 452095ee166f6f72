"""Annual latitude-band tables and other annual aggregates of events and cells.

Tables stay long (a row for each domain, year and band), and domains are a grouping column, so that all
hemispheres, basins and surfaces go through one plan. Aggregation is partial in the map tasks; what is
shuffled is a row for each group and task, however large the events are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import BASIN_HEMISPHERE, band, band_label, hemisphere, ratio

N_BANDS = 4
VALUE = "EVENT_INTENSITY_MM_3H"


def densified(table: DataFrame, keys: Sequence[str], years: tuple[int, int], fill: dict[str, Column], bands: bool = True, domains: DataFrame | None = None) -> DataFrame:
    """`table` on the whole grid of its domains, all years and bands; gaps take the values of `fill`."""
    grid = (domains if domains is not None else table.select(*keys)).select(*keys).distinct()
    grid = grid.withColumn("YEAR", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    on = [*keys, "YEAR"]
    if bands:
        grid, on = grid.withColumn("BAND", F.explode(F.sequence(F.lit(0), F.lit(N_BANDS - 1)))), [*on, "BAND"]
    out = grid.join(table, on, "left")
    return out.select(*on, *(F.coalesce(c, v).alias(c) if (v := fill.get(c)) is not None else F.col(c) for c in table.columns if c not in on))


def annual_bands(events: DataFrame, keys: Sequence[str], years: tuple[int, int], hemi: Column | str = "HEMISPHERE", value: str = VALUE, strict: bool = True, domains: DataFrame | None = None) -> DataFrame:
    """keys, YEAR, BAND, N_EVENTS, INTENSITY_SUM, MEAN_INTENSITY, RELATIVE_FREQUENCY on the dense grid.

    `hemi` says by which hemisphere's bands an event is placed. strict: an event outside all bands is an
    error; else it is left out. Means and shares are null where there is nothing to divide by.
    """
    h = F.col(hemi) if isinstance(hemi, str) else hemi
    placed = events.withColumn("BAND", band("TC_LAT", h))
    if strict:
        placed = placed.withColumn("BAND", F.when(F.coalesce(F.col("BAND"), F.lit(-1)) < 0, F.raise_error(F.lit("event outside the latitude bands")).cast("int")).otherwise(F.col("BAND")))
    sums = placed.groupBy(*keys, F.col("YEAR").cast("int").alias("YEAR"), "BAND").agg(F.count(F.lit(1)).alias("N_EVENTS"), F.sum(F.col(value).cast("double")).alias("INTENSITY_SUM"))
    dense = densified(sums, keys, years, {"N_EVENTS": F.lit(0), "INTENSITY_SUM": F.lit(0.0)}, domains=domains)
    total = F.sum("N_EVENTS").over(W.partitionBy(*keys, "YEAR"))
    return dense.select("*", ratio("INTENSITY_SUM", "N_EVENTS").alias("MEAN_INTENSITY"), ratio(F.col("N_EVENTS"), total).alias("RELATIVE_FREQUENCY"))


def labelled(table: DataFrame, hemi: str = "HEMISPHERE", public: bool = True) -> DataFrame:
    return table.withColumn("BAND_LABEL", band_label(hemi, "BAND", public))


def basin_domains(events: DataFrame) -> DataFrame:
    """Events once for their hemisphere and once for their basin: columns domain and domain_hemisphere.

    A basin's bands are those of its nominal hemisphere; events of basins without one (the South Atlantic)
    count for the hemisphere alone.
    """
    own = F.create_map(*(F.lit(v) for kv in BASIN_HEMISPHERE.items() for v in kv))
    basin = F.when(F.col("BASIN").isin(*BASIN_HEMISPHERE), F.struct(F.col("BASIN").alias("domain"), F.element_at(own, F.col("BASIN")).alias("domain_hemisphere")))
    whole = F.struct(F.col("HEMISPHERE").alias("domain"), F.col("HEMISPHERE").alias("domain_hemisphere"))
    return events.withColumn("_d", F.explode(F.array_compact(F.array(whole, basin)))).select("*", "_d.*").drop("_d")


def annual_means(events: DataFrame, value: str = VALUE, by: str = "HEMISPHERE", whole: str = "GLOBAL", years: tuple[int, int] | None = None) -> DataFrame:
    """domain, YEAR, n, mean: for all events together and for each value of `by`, by grouping sets."""
    agg = events.groupingSets([[F.col("YEAR")], [F.col(by), F.col("YEAR")]], F.col(by), F.col("YEAR")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), F.grouping(by).alias("_g"))
    out = agg.select(F.when(F.col("_g") == 1, whole).otherwise(F.col(by)).alias("domain"), F.col("YEAR").cast("int").alias("YEAR"), "n", "mean")
    return out if years is None else densified(out, ["domain"], years, {"n": F.lit(0)}, bands=False)


def degree_cell_means(cells: DataFrame, value: str, lat: str, lon: str, least_years: int = 10) -> DataFrame:
    """lat, lon, YEAR, mean of each 1-degree cell and year; of cells with `least_years` years of data."""
    from ..functions.geo import degree_cell

    a, b = degree_cell(lat, lon)
    v = F.col(value).cast("double")
    annual = cells.select(a.alias("lat"), b.alias("lon"), "YEAR", F.when(~F.isnan(v), v).alias("v")).groupBy("lat", "lon", "YEAR").agg(F.avg("v").alias("mean")).where("mean IS NOT NULL")
    return annual.withColumn("valid_years", F.count(F.lit(1)).over(W.partitionBy("lat", "lon"))).where(F.col("valid_years") >= least_years)


def surface_bands(cells: DataFrame, years: tuple[int, int], value: str, surface: str = "SURFACE") -> DataFrame:
    """HEMISPHERE, surface, YEAR, BAND, n_j, vol_j: cell counts and sums of intensities, dense in years and bands."""
    rows = cells.withColumn("HEMISPHERE", hemisphere("TC_LAT"))
    rows = rows.withColumn("BAND", band("TC_LAT", "HEMISPHERE")).where("BAND >= 0")
    sums = rows.groupBy("HEMISPHERE", surface, "YEAR", "BAND").agg(F.count(F.lit(1)).alias("n_j"), F.sum(F.col(value).cast("double")).alias("vol_j"))
    return densified(sums, ["HEMISPHERE", surface], years, {"n_j": F.lit(0), "vol_j": F.lit(0.0)})


def with_surface(cells: DataFrame, land: DataFrame) -> DataFrame:
    """SURFACE land or ocean by ROW; `land` lists the rows on land. Spark broadcasts them if they are few enough by size."""
    mask = land.select(F.col("ROW").alias("_row")).distinct()
    return cells.join(mask, F.col("ROW") == F.col("_row"), "left").withColumn("SURFACE", F.when(F.col("_row").isNotNull(), "land").otherwise("ocean")).drop("_row")


def mean_latitude(tracks: DataFrame, events: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """record_type, domain, YEAR, mean_lat, n_records: mean absolute latitude of positions and of events.

    years: each domain has a row for all of them, with nulls where there are no records.
    """
    lat = lambda df, c, kind: df.select(F.lit(kind).alias("record_type"), hemisphere(c).alias("domain"), "YEAR", F.abs(F.col(c).cast("double")).alias("_l"))
    both = lat(tracks, "LAT", "track").unionByName(lat(events, "TC_LAT", "event"))
    out = both.groupBy("record_type", "domain", F.col("YEAR").cast("int").alias("YEAR")).agg(F.avg("_l").alias("mean_lat"), F.count(F.lit(1)).alias("n_records"))
    return out if years is None else densified(out, ["record_type", "domain"], years, {}, bands=False)


def basin_band_counts(events: DataFrame) -> DataFrame:
    """BASIN, BAND, n_events: bands by each event's own hemisphere."""
    return events.withColumn("BAND", band("TC_LAT", hemisphere("TC_LAT"))).groupBy("BASIN", "BAND").agg(F.count(F.lit(1)).alias("n_events"))
