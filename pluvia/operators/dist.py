"""Distributions: quantiles, histograms, kernel densities, zonal profiles, boxes on a map."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import display_lon
from . import selection
from .keys import join_by

LEVELS = (0.1, 0.5, 0.9, 0.99)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """keys, q10, q50, ... : exact quantiles with linear interpolation, by selection; no task holds a group."""
    q = selection.quantiles(df, keys, value, levels)
    return q.select(*keys, *(F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(levels)))


def medians_and_counts(df: DataFrame, keys: Sequence[str], value: str, year: str = "YEAR") -> DataFrame:
    """keys, n, median, mean_of_years: pooled count and median, and the mean of annual means; null is a key like others."""
    pooled = selection.quantiles(df, keys, value, [0.5]).select(*keys, "n", F.col("q")[0].alias("median"))
    means = df.groupBy(*keys, year).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("mean_of_years"))
    return join_by(pooled, means, list(keys))


def histogram_density(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """keys, BIN, left, n, density: left-closed bins, the last one closed too, normalised by all values.

    Values outside the bins count for n of the key, so that the mass is their share inside.
    """
    width = (high - low) / bins
    b = F.when((F.col(value) >= low) & (F.col(value) < high), F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))).when(F.col(value) == high, bins - 1)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, b.cast("int").alias("BIN")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("_t"))
    out = n.where("BIN IS NOT NULL").join(total, list(keys))
    return out.select(*keys, "BIN", (F.lit(low) + F.col("BIN") * width).alias("left"), "n", (F.col("n") / F.col("_t") / width).alias("density"))


#: Kernels end where they are below 1e-17 of their height.
REACH = 9.0


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, points: int = 400) -> DataFrame:
    """keys, x, density: Gaussian kernels of Scott's width (stddev n**-1/5) at `points` places; null is a key like others.

    Equal values weigh together, so that the work follows the distinct values. Each adds to the places within REACH
    widths alone, and sums are combined in the map tasks. Of fewer than two values, or equal ones, there is no width: density is null.
    """
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    stat = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_s"))
    stat = stat.select(*keys, "_n", F.when(F.col("_s") > 0, F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"))
    step = (high - low) / (points - 1)
    rows = join_by(known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w")), stat, list(keys)) if keys else known.groupBy("_v").agg(F.count(F.lit(1)).alias("_w")).crossJoin(stat)
    first = F.greatest(F.lit(0), F.ceil((F.col("_v") - REACH * F.col("_h") - low) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("_v") + REACH * F.col("_h") - low) / step)).cast("int")
    near = rows.where(F.col("_h").isNotNull() & (first <= last)).withColumn("_k", F.explode(F.sequence(first, last)))
    z = (F.lit(low) + F.col("_k") * step - F.col("_v")) / F.col("_h")
    sums = near.groupBy(*keys, "_k").agg(F.sum(F.col("_w") * F.exp(-z * z / 2)).alias("_d"))
    places = stat.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = join_by(places, sums, [*keys, "_k"], "left")
    return out.select(*keys, (F.lit(low) + F.col("_k") * step).alias("x"), (F.coalesce("_d", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def zonal_profile(cells: DataFrame, value: str = "trend", lat: str = "lat") -> DataFrame:
    """lat, mean, std (of the population), n: mapped values by latitude."""
    return cells.groupBy(lat).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def box_means(cells: DataFrame, boxes: DataFrame, value: str = "trend") -> DataFrame:
    """box, name, mean, n of the map cells inside each box (edges included); boxes are a handful of rows."""
    b = F.broadcast(boxes.select("box", "name", "lon_min", "lon_max", "lat_min", "lat_max"))
    c = cells.withColumn("_lon", display_lon("lon"))
    inside = (F.col("_lon") >= F.col("lon_min")) & (F.col("_lon") <= F.col("lon_max")) & (F.col("lat") >= F.col("lat_min")) & (F.col("lat") <= F.col("lat_max"))
    return c.join(b, inside).groupBy("box", "name").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
