"""Exact order statistics of large groups, without sorting or holding a group.

Two passes over the rows. The first keeps a mergeable sketch for each key, which says within which values a wanted
rank lies for certain. The second counts rows by cell: inside such a bracket a cell is one value, and all
rows between two brackets are one cell, counted in the map tasks. Running counts over a key's cells then name the exact value
at any rank. What is shuffled is sketches and cells; a key's cells are a few thousandths of its distinct values,
or all of them in a group of SMALL rows at most.

Rows without a value, or with NaN, are left out; null is a key like others. Should a sketch ever have
missed a rank, the result is an error and not a wrong value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: 1 / ACCURACY is the sketch's greatest error of a rank, by the number of rows; brackets are SLACK times as wide.
ACCURACY, SLACK = 10_000, 3
SMALL = 4 * ACCURACY


def cells(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """keys, v, exact, before, upto, n: cells in order of their values v, with the rows before and up to their end.

    exact: all rows of the cell have the value v. All ranks near a level times n lie in exact cells.
    """
    v = F.col(value)
    rows = df.select(*keys, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v.cast("double")))
    edges = [e for p in levels for e in (p - SLACK / ACCURACY, p + SLACK / ACCURACY)]
    asked = [min(1.0, max(0.0, e)) for e in edges]
    cut = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", asked, ACCURACY).alias("_c"))
    r, c = rows.alias("r"), cut.alias("c")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    met = r.join(c, on) if keys else r.crossJoin(c)  # the other side is one row
    met = met.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_v", "_n", "_c")
    inside, gap = F.col("_n") <= SMALL, F.lit(0)
    for i in range(0, len(edges), 2):
        low = F.lit(True) if edges[i] <= 0 else F.col("_v") >= F.col("_c")[i]
        high = F.lit(True) if edges[i + 1] >= 1 else F.col("_v") <= F.col("_c")[i + 1]
        inside, gap = inside | (low & high), gap + low.cast("int")
    told = met.select(*keys, "_v", "_n", F.when(inside, F.col("_v")).alias("_own"), F.when(~inside, gap).alias("_gap"))
    few = told.groupBy(*keys, "_own", "_gap").agg(F.max("_v").alias("v"), F.count(F.lit(1)).alias("_w"), F.max("_n").alias("n"))
    upto = F.sum("_w").over(W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    return few.select(*keys, "v", F.col("_own").isNotNull().alias("exact"), (upto - F.col("_w")).alias("before"), upto.alias("upto"), "n")


def at(position: Column) -> Column:
    """An aggregate over the cells of a key: the value at a position from 0, which must lie in an exact cell."""
    found = (F.col("before") <= position) & (position < F.col("upto"))
    inexact = F.raise_error(F.lit("a rank outside the brackets of its sketch"))
    return F.max(F.when(found & F.col("exact"), F.col("v")).when(found, inexact.cast("double")))


def _selected(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], out: Callable[[float], dict[str, Column]]) -> DataFrame:
    aggs = [c.alias(name) for p in levels for name, c in out(p).items()]
    return cells(df, keys, value, levels).groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, level: float, out: str = "value") -> DataFrame:
    """keys, n, `out`: the value at rank ceil(level n) of the sorted values, from 1."""
    rank = F.greatest(F.ceil(F.lit(level) * F.col("n")), F.lit(1)) - 1
    found = _selected(df, keys, value, [level], lambda p: {out: at(rank)})
    return found.withColumn(out, F.col(out).cast(df.schema[value].dataType))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """keys, n, q: exact quantiles of the levels, interpolated between neighbours, as an array."""

    def ends(p: float) -> dict[str, Column]:
        where = F.lit(p) * (F.col("n") - 1)
        return {f"_a{p}": at(F.floor(where)).cast("double"), f"_b{p}": at(F.ceil(where)).cast("double")}

    found = _selected(df, keys, value, list(dict.fromkeys(levels)), ends)

    def between(p: float) -> Column:
        where = F.lit(p) * (F.col("n") - 1)
        a, b = F.col(f"`_a{p}`"), F.col(f"`_b{p}`")
        return F.when(a == b, a).otherwise((F.ceil(where) - where) * a + (where - F.floor(where)) * b)

    return found.select(*keys, "n", F.array(*map(between, levels)).alias("q"))
