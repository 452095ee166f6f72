"""Local 99th percentiles of wet cells: exact, or by histogram with exact values where it ends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import is_wet
from . import selection

# Fixed values.
LOW, HIGH, BINS, QUANTILE = 0.3, 120.0, 500, 0.99
WET_SAMPLE_RULE = ">0.3 mm/3h"
QUANTILE_METHOD = "nearest-rank; exact unbounded refinement when POT99 >120 mm/3h"
METHODS = {"histogram": "nearest-rank 500-bin histogram", "exact": "exact nearest-rank (unbounded tail refinement)"}


def edges() -> np.ndarray:
    """The bins' edges, in single precision."""
    return np.linspace(LOW, HIGH, BINS + 1).astype(np.float32)


def centres() -> np.ndarray:
    e = edges()
    return ((e[:-1] + e[1:]) / np.float32(2)).astype(np.float32)


def _floats(x: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in x)).cast("array<float>")


def bin_of(value: Column) -> Column:
    """Number of the right-closed bin of a wet value, BINS above the last edge.

    Arithmetic gives a candidate that is off by one at most; comparing it with the edges themselves, in
    single precision, puts it right.
    """
    v = value.cast("float")
    e = _floats(edges())
    width = (HIGH - LOW) / BINS
    c = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), (F.ceil((v.cast("double") - LOW) / width) - 1).cast("int")))
    fixed = F.when(v > F.get(e, c + 1), c + 1).when(v <= F.get(e, c), c - 1).otherwise(c)
    return F.when(v > F.lit(HIGH).cast("float"), F.lit(BINS)).otherwise(F.greatest(fixed, F.lit(0))).cast("int")


def histogram(cells: DataFrame, value: str, key: str = "ROW") -> DataFrame:
    """key, BIN, N of wet values; BIN 500 holds those above the last edge. Sparse: bins without values have no row."""
    return cells.where(is_wet(value)).groupBy(key, bin_of(F.col(value)).alias("BIN")).agg(F.count(F.lit(1)).alias("N"))


def merged(*histograms: DataFrame, key: str = "ROW") -> DataFrame:
    """The sum of histograms, such as those of single years."""
    out = histograms[0].select(key, "BIN", "N")
    for h in histograms[1:]:
        out = out.unionByName(h.select(key, "BIN", "N"))
    return out.groupBy(key, "BIN").agg(F.sum("N").alias("N"))


def from_histogram(hist: DataFrame, key: str = "ROW") -> DataFrame:
    """key, N_WET, POT99, THRESHOLD_METHOD: the centre of the bin that holds the nearest rank.

    POT99 is null, and the method `unresolved`, where the rank lies above the last edge.
    """
    w = W.partitionBy(key)
    t = hist.withColumn("N_WET", F.sum("N").over(w)).withColumn("_c", F.sum("N").over(w.orderBy("BIN").rowsBetween(W.unboundedPreceding, W.currentRow)))
    rank = F.ceil(F.lit(QUANTILE) * F.col("N_WET"))
    t = t.where(F.col("_c") >= rank).groupBy(key).agg(F.max("N_WET").alias("N_WET"), F.min("BIN").alias("BIN"))
    return t.select(key, "N_WET", F.when(F.col("BIN") < BINS, F.get(_floats(centres()), F.col("BIN"))).alias("POT99"), F.when(F.col("BIN") < BINS, "histogram").otherwise("unresolved").alias("THRESHOLD_METHOD"))


def exact(cells: DataFrame, value: str, key: str = "ROW") -> DataFrame:
    """key, N_WET, POT99: the value at the nearest rank, ceil(0.99 n), of the wet values, by selection."""
    wet = cells.where(is_wet(value)).select(key, F.col(value).cast("float").alias("v"))
    return selection.nearest_rank(wet, [key], "v", QUANTILE, "POT99").select(key, F.col("n").alias("N_WET"), "POT99")


#: Cells left unresolved that are named to the files, so that only their row groups or latitudes are read.
FEW = 2000


def refined(cells: DataFrame, value: str, key: str = "ROW", hist: DataFrame | None = None) -> DataFrame:
    """key, N_WET, POT99, THRESHOLD_METHOD: by histogram (`hist` if it is kept), and exactly for the cells it leaves unresolved.

    Only cells left unresolved are read again: by a semi-join, and with a histogram that is kept also by their numbers,
    if they are FEW at most. Their counts must agree with the histogram.
    """
    first = from_histogram(histogram(cells, value, key) if hist is None else hist, key)
    rest = first.where("THRESHOLD_METHOD = 'unresolved'").select(key, F.col("N_WET").alias("_n"))
    if hist is not None:
        named = [r[0] for r in rest.select(key).limit(FEW + 1).collect()]
        if len(named) <= FEW:
            cells = cells.where(F.col(key).isin(named))
    again = exact(cells.join(rest, key, "left_semi"), value, key).join(rest, key)
    again = again.withColumn("POT99", F.when(F.col("_n") == F.col("N_WET"), F.col("POT99")).otherwise(F.raise_error(F.lit("counts of an exact cell differ from the histogram")).cast("float")))
    done = first.where("THRESHOLD_METHOD = 'histogram'")
    return done.unionByName(again.select(key, "N_WET", "POT99", F.lit("exact").alias("THRESHOLD_METHOD")))
