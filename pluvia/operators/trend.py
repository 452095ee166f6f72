"""Theil-Sen slopes, Sen lines and the Mann-Kendall test for many series at once.

A series is all rows with the same keys. Its points (t, y) are collected into one sorted array, so that a batch
of series costs one shuffle of its points and no self-join. Up to PAIRWISE points (years, months), pairs are
formed inside the row by higher-order functions; longer series (days, three-hour steps) go to numpy, which
selects the median slope and counts inversions in O(n log n), see `slopes`. Both give the same statistics. Rows
with null or non-finite y, or null t, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.normal import two_sided
from ..session import ship
from .slopes import median_slope, signs

#: Points of a series whose pairs are formed in one row.
PAIRWISE = 256


def _finite(y: str) -> Column:
    c = F.col(y).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def points(df: DataFrame, keys: list[str], y: str, t: str) -> DataFrame:
    """keys, p: array of (t, y), sorted by t."""
    one = F.struct(F.col(t).cast("double").alias("t"), _finite(y).alias("y"))
    kept = F.when(_finite(y).isNotNull() & F.col(t).isNotNull(), one)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(kept)).alias("p"))


def _pairs(value) -> Column:
    """value(earlier, later) over all pairs of points with different t, as one array."""
    rest = lambda i: F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0)))
    each = lambda a, i: F.transform(F.filter(rest(i), lambda b: b["t"] > a["t"]), lambda b: value(a, b))
    return F.flatten(F.transform("p", each))


def median_of(a: Column) -> Column:
    """Median of an array of doubles; null if it is empty."""
    s = F.array_sort(a)
    n = F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def slope_of() -> Column:
    """Sen slope of the points p by unit of t; null with fewer than three."""
    return F.when(F.size("p") >= 3, median_of(_pairs(lambda a, b: (b["y"] - a["y"]) / (b["t"] - a["t"]))))


def with_statistics(p: DataFrame) -> DataFrame:
    """Rows with p, an array of points sorted by t, with slope (by unit of t), s and tie (of Mann-Kendall).

    slope is null with fewer than three points, or without two of different t.
    """
    short = p.where(F.size("p") <= PAIRWISE).withColumn("slope", slope_of()).withColumn("s", F.aggregate(_pairs(lambda a, b: F.signum(b["y"] - a["y"])), F.lit(0.0), lambda a, x: a + x))
    ys = F.transform("p", lambda q: q["y"])
    ties = F.transform(F.array_distinct(ys), lambda v: F.size(F.filter(ys, lambda x: x == v)).cast("double"))
    short = short.withColumn("tie", F.aggregate(ties, F.lit(0.0), lambda a, c: a + c * (c - 1) * (2 * c + 5)))
    at, names = p.columns.index("p"), [*p.columns, "slope", "s", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            points = b.column(at)
            parts = points.flatten()
            t, y = (parts.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("t", "y"))
            ends = np.cumsum([0, *points.value_lengths().to_pylist()])
            found = [(median_slope(t[i:j], y[i:j]), *map(float, signs(t[i:j], y[i:j]))) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([*b.columns, *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], names)

    ship(p.sparkSession)
    schema = StructType([*p.schema.fields, *(StructField(k, DoubleType()) for k in names[-3:])])
    return short.unionByName(p.where(F.size("p") > PAIRWISE).mapInArrow(run, schema))


def theil_sen(df: DataFrame, keys: list[str], y: str, t: str = "YEAR", per: float = 10.0, out: str = "slope") -> DataFrame:
    """keys, `out`: the median of pairwise slopes times `per` (10: by decade from years)."""
    return with_statistics(points(df, keys, y, t)).select(*keys, (F.col("slope") * per).alias(out))


def slopes_by_join(df: DataFrame, keys: list[str], y: str, t: str = "YEAR", per: float = 10.0, out: str = "slope") -> DataFrame:
    """As `theil_sen`, by a self-join on the keys: every pair is a row, so it is for checks and short series."""
    one = df.select(*keys, F.col(t).cast("double").alias("_t"), _finite(y).alias("_y")).where("_y IS NOT NULL AND _t IS NOT NULL")
    a, b = one.alias("a"), one.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pairs = a.join(b, [*on, F.col("a._t") < F.col("b._t")]).select(*(F.col(f"a.{k}").alias(k) for k in keys), ((F.col("b._y") - F.col("a._y")) / (F.col("b._t") - F.col("a._t"))).alias("_s"))
    enough = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = pairs.groupBy(*keys).agg(F.percentile("_s", F.lit(0.5)).alias("_m"))
    return enough.join(found, keys, "left").select(*keys, F.when(F.col("_n") >= 3, F.col("_m") * per).alias(out))


def sen_line(df: DataFrame, keys: list[str], y: str, t: str = "YEAR", joint: bool = True) -> DataFrame:
    """keys, t, y, slope, intercept, fit, residual for each row of `df`, in one pass over it.

    joint: the intercept is the median of y - slope t, and a series without a slope is flat; else it is
    median(y) - slope median(t), as components are fitted.
    """
    one = F.struct(F.col(t).alias("t"), F.col(y).alias("v"), F.col(t).cast("double").alias("x"), _finite(y).alias("y"))
    p = df.groupBy(*keys).agg(F.collect_list(one).alias("all"))
    known = F.filter("all", lambda q: q["x"].isNotNull() & q["y"].isNotNull())
    p = p.withColumn("p", F.array_sort(F.transform(known, lambda q: F.struct(q["x"].alias("t"), q["y"].alias("y")))))
    p = with_statistics(p).drop("s", "tie")
    if joint:
        p = p.withColumn("slope", F.coalesce("slope", F.lit(0.0)))
        level = median_of(F.transform("p", lambda q: q["y"] - F.col("slope") * q["t"]))
    else:
        level = median_of(F.transform("p", lambda q: q["y"])) - F.col("slope") * median_of(F.transform("p", lambda q: q["t"]))
    rows = p.withColumn("intercept", level).select(*keys, "slope", "intercept", F.explode("all").alias("_q"))
    fit = F.col("intercept") + F.col("slope") * F.col("_q.t")
    return rows.select(*keys, F.col("_q.t").alias(t), F.col("_q.v").alias(y), "slope", "intercept", fit.alias("fit"), (F.col("_q.y") - fit).alias("residual"))


def mann_kendall(df: DataFrame, keys: list[str], y: str, t: str = "YEAR", full: bool = False) -> DataFrame:
    """keys, p_value: two-sided, with corrections for continuity and ties; with `full` also n, s, var, z.

    Null with fewer than three points, 1 if the variance is not positive.
    """
    return _tested(with_statistics(points(df, keys, y, t))).select(*keys, *(["n", "s", "var", "z"] if full else []), "p_value")


def _tested(p: DataFrame) -> DataFrame:
    """Rows of `with_statistics` with n, var, z, p_value of the test."""
    p = p.withColumn("n", F.size("p").cast("long"))
    n = F.col("n").cast("double")
    p = p.withColumn("var", (n * (n - 1) * (2 * n + 5) - F.col("tie")) / 18)
    p = p.withColumn("z", F.when(F.col("var") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var")))
    return p.withColumn("p_value", F.when(F.col("n") < 3, None).when(F.col("var") <= 0, 1.0).otherwise(two_sided(F.col("z"))))


def trends(df: DataFrame, keys: list[str], y: str, t: str = "YEAR", per: float = 10.0) -> DataFrame:
    """keys, slope, p_value, n: both statistics from one pass over the series; null is a key like others."""
    p = with_statistics(points(df, keys, y, t)).withColumn("slope", F.col("slope") * per)
    return _tested(p).select(*keys, "slope", "n", "p_value")
