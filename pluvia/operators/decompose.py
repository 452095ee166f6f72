"""Decomposition of annual mean intensity over latitude bands.

With shares a and means m of the bands in a year, and their climatological means A and M, the annual mean is
sum(a m) = sum(A M) + sum((a - A) M) + sum(A (m - M)) + sum((a - A) (m - M)): the reference, redistribution,
within-band and interaction terms, exactly. M is the mean of the annual means there are; a missing m is M.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import ratio
from .keys import join_by
from .trend import trends

COMPONENTS = ("ANNUAL_MEAN", "REFERENCE", "REDISTRIBUTION", "WITHIN_BAND", "INTERACTION")
TRENDED = {"TOTAL": "ANNUAL_MEAN", "REDISTRIBUTION": "REDISTRIBUTION", "WITHIN_BAND": "WITHIN_BAND", "INTERACTION": "INTERACTION"}


def components(bands: DataFrame, keys: Sequence[str], n: str = "N_EVENTS", total: str = "INTENSITY_SUM", strict: bool = True) -> DataFrame:
    """keys, YEAR, the five terms, CLOSURE_ERROR for each year of a dense band table.

    strict: a year without events, or a band without any in all years, is an error, as is a closure error
    above 1e-10. Without it such a year has a null mean, and such a band adds nothing.
    """
    own = W.partitionBy(*keys, "BAND")
    year = W.partitionBy(*keys, "YEAR")
    count = F.sum(n).over(year)
    a = ratio(F.col(n), count, 0.0)
    if strict:
        a = F.when(count > 0, a).otherwise(F.raise_error(F.lit("a year has no events")).cast("double"))
    t = bands.select(*keys, "YEAR", "BAND", a.alias("share"), ratio(total, n).alias("mean"), count.alias("_n"))
    t = t.withColumn("usual_share", F.avg("share").over(own)).withColumn("usual_mean", F.avg("mean").over(own))
    if strict:
        t = t.withColumn("usual_mean", F.coalesce("usual_mean", F.raise_error(F.lit("a band has no events in any year")).cast("double")))
    t = t.withColumn("mean", F.coalesce("mean", "usual_mean"))
    a0, m0, da, dm = F.col("usual_share"), F.col("usual_mean"), F.col("share") - F.col("usual_share"), F.col("mean") - F.col("usual_mean")
    terms = (F.col("share") * F.col("mean"), a0 * m0, da * m0, a0 * dm, da * dm)
    out = t.groupBy(*keys, "YEAR").agg(*(F.sum(x).alias(c) for x, c in zip(terms, COMPONENTS, strict=True)), F.max("_n").alias("_n"))
    if not strict:
        out = out.withColumn("ANNUAL_MEAN", F.when(F.col("_n") > 0, F.col("ANNUAL_MEAN")))
    gap = F.col("ANNUAL_MEAN") - (F.col("REFERENCE") + F.col("REDISTRIBUTION") + F.col("WITHIN_BAND") + F.col("INTERACTION"))
    if strict:
        gap = F.when(F.abs(gap) <= 1e-10, gap).otherwise(F.raise_error(F.lit("the decomposition does not close")).cast("double"))
    return out.select(*keys, "YEAR", *COMPONENTS, gap.alias("CLOSURE_ERROR"))


def long_components(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, YEAR, COMPONENT, value: the four trended terms as rows."""
    return parts.select(*keys, "YEAR", F.explode(F.array(*(F.struct(F.lit(k).alias("COMPONENT"), F.col(c).alias("value")) for k, c in TRENDED.items()))).alias("_x")).select(*keys, "YEAR", "_x.*")


def component_trends(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, COMPONENT, slope by decade, p_value, n. Sums over bands come first: slopes do not add up."""
    return trends(long_components(parts, keys), [*keys, "COMPONENT"], "value")


def band_terms(bands: DataFrame, keys: Sequence[str], n: str = "N_EVENTS", total: str = "INTENSITY_SUM") -> DataFrame:
    """keys, BAND, migration, intensity, residual, total: slopes by decade of each band.

    migration = slope of the band's share x its mean intensity, intensity = its mean share x slope of its
    intensity (years without events left out), total = slope of its part of the annual mean, residual the
    rest, which holds interaction and what slopes do not add up to. A slope that does not exist is 0.
    """
    year = W.partitionBy(*keys, "YEAR")
    count = F.sum(n).over(year)
    t = bands.select(*keys, "YEAR", "BAND", ratio(F.col(n), count, 0.0).alias("share"), ratio(total, n).alias("mean"), ratio(F.col(total), count, 0.0).alias("part"))
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("share", "mean", "part")))
    slopes = trends(t.select(*keys, "YEAR", "BAND", F.explode(kinds).alias("_x")).select(*keys, "YEAR", "BAND", "_x.*"), [*keys, "BAND", "kind"], "value")
    wide = slopes.groupBy(*keys, "BAND").agg(*(F.coalesce(F.max(F.when(F.col("kind") == c, F.col("slope"))), F.lit(0.0)).alias(f"s_{c}") for c in ("share", "mean", "part")))
    means = t.groupBy(*keys, "BAND").agg(F.avg("share").alias("share"), F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean"))
    met = join_by(wide, means, [*keys, "BAND"])
    x = met.select(*keys, "BAND", (F.col("s_share") * F.col("mean")).alias("migration"), (F.col("share") * F.col("s_mean")).alias("intensity"), F.col("s_part").alias("total"))
    return x.select(*keys, "BAND", "migration", "intensity", (F.col("total") - F.col("migration") - F.col("intensity")).alias("residual"), "total")


def annual_series(bands: DataFrame, keys: Sequence[str], n: str = "N_EVENTS", total: str = "INTENSITY_SUM") -> DataFrame:
    """keys, YEAR, N_t, mean: all bands of a year together; 0 for a year without events."""
    g = bands.groupBy(*keys, "YEAR").agg(F.sum(n).alias("N_t"), F.sum(total).alias("_v"))
    return g.select(*keys, "YEAR", "N_t", ratio("_v", "N_t", 0.0).alias("mean"))


def masked(bands: DataFrame, counts: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Estimates of bands with their event counts (0 if none), null where there are no events."""
    x = bands.join(counts, list(on), "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return x.select(*(F.when(F.col("n_events") > 0, F.col(c)).alias(c) if c in values else F.col(c) for c in x.columns))


def significance(trend_rows: DataFrame, intervals: DataFrame, on: Sequence[str]) -> DataFrame:
    """Trends with their intervals, and whether those leave out 0; null is a key like others.

    One to one: a key that either side has twice is an error, as such rows would multiply.
    """
    low, high = F.col("ci_low"), F.col("ci_high")

    def once(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(*on))
        return df.withColumn("_n", F.when(n == 1, n).otherwise(F.raise_error(F.lit("trends and intervals do not match one to one")).cast("long"))).where("_n = 1").drop("_n")

    met = join_by(once(trend_rows), once(intervals.select(*on, "ci_low", "ci_high")), on)
    return met.withColumn("significant", (low > 0) | (high < 0))
