"""Extreme cells and storm events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exceeds, hemisphere

ROWS = 6_480_000


def checked_thresholds(thresholds: DataFrame, value: str = "POT99_MM_3H", key: str = "ROW", rows: int | None = ROWS) -> DataFrame:
    """The table, with an error for a row number that occurs twice or lies off the grid, when it is read."""
    t = thresholds.groupBy(key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n"))
    bad = F.col("_n") > 1
    if rows is not None:
        bad = bad | (F.col(key) < 0) | (F.col(key) >= rows)
    return t.select(F.when(~bad, F.col(key)).otherwise(F.raise_error(F.lit("duplicate or invalid row in the thresholds")).cast(thresholds.schema[key].dataType)).alias(key), value)


def extreme_cells(cells: DataFrame, thresholds: DataFrame, precip: str = "PRECIP_3H_MM", value: str = "POT99_MM_3H", key: str = "ROW") -> DataFrame:
    """Cells strictly above their own threshold, with it. A cell without a threshold, or with NaN, is left out."""
    return cells.join(thresholds.select(key, value), key).where(exceeds(precip, value))


def build_events(extreme: DataFrame, precip: str = "PRECIP_3H_MM", flag: str = "IS_INTERPOLATED_TIMESTEP") -> DataFrame:
    """An event for each storm and time step: mean over its extreme cells, their number, and its provenance.

    Sums are in double precision and combined in the map tasks; how cells are split has no effect.
    """
    e = extreme.groupBy("SID", "TIME").agg(
        F.min("BASIN").alias("BASIN"),
        F.min("TC_LAT").alias("TC_LAT"),
        F.avg(F.col(precip).cast("double")).alias("EVENT_INTENSITY_MM_3H"),
        F.count(F.lit(1)).alias("N_EXTREME_CELLS"),
        F.max(flag).alias(flag),
    )
    return e.select("SID", "TIME", F.year("TIME").alias("YEAR"), hemisphere("TC_LAT").alias("HEMISPHERE"), "BASIN", "TC_LAT", "EVENT_INTENSITY_MM_3H", "N_EXTREME_CELLS", flag)


def partial_events(extreme: DataFrame, precip: str = "PRECIP_3H_MM", flag: str = "IS_INTERPOLATED_TIMESTEP") -> DataFrame:
    """Sums, counts and flags of one batch; batches add up with `merged_events`."""
    return extreme.groupBy("SID", "TIME").agg(F.min("BASIN").alias("BASIN"), F.min("TC_LAT").alias("TC_LAT"), F.sum(F.col(precip).cast("double")).alias("S"), F.count(F.lit(1)).alias("N"), F.max(flag).alias(flag))


def merged_events(*parts: DataFrame, flag: str = "IS_INTERPOLATED_TIMESTEP") -> DataFrame:
    """Events of several batches."""
    p = parts[0]
    for x in parts[1:]:
        p = p.unionByName(x)
    p = p.groupBy("SID", "TIME").agg(F.min("BASIN").alias("BASIN"), F.min("TC_LAT").alias("TC_LAT"), F.sum("S").alias("S"), F.sum("N").alias("N"), F.max(flag).alias(flag))
    return p.select("SID", "TIME", F.year("TIME").alias("YEAR"), hemisphere("TC_LAT").alias("HEMISPHERE"), "BASIN", "TC_LAT", (F.col("S") / F.col("N")).alias("EVENT_INTENSITY_MM_3H"), F.col("N").alias("N_EXTREME_CELLS"), flag)
