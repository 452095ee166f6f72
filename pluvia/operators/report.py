"""Tables for people: compact cells, Markdown, and keyed report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_significant, shown

PARTS = ("migration", "intensity", "residual")


def marked(df: DataFrame, point: str, low: str, high: str, out: str) -> DataFrame:
    """`out`: the number with an asterisk if its interval leaves out 0."""
    return df.withColumn(out, F.concat(shown(point), F.when(is_significant(low, high), "*").otherwise("")))


def compact(terms: DataFrame, keys: Sequence[str], parts: Sequence[str] = PARTS) -> DataFrame:
    """keys, band_0..band_3: `redistribution / within / residual` of each band in one cell, a dash without data."""
    x = terms
    for p in parts:
        x = marked(x, f"{p}_point", f"{p}_ci_low", f"{p}_ci_high", f"_{p}")
    x = x.withColumn("cell", F.concat_ws(" / ", *(f"_{p}" for p in parts)))
    return x.groupBy(*keys).agg(*(F.max(F.when(F.col("BAND") == k, F.col("cell"))).alias(f"band_{k}") for k in range(4)))


def upserted(existing: DataFrame, new: DataFrame, key: str = "YEAR") -> DataFrame:
    """Report rows with those of `new` in place of the old ones of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def markdown(df: DataFrame, order: Sequence[str] = ()) -> str:
    """A small table as Markdown."""
    rows = [list(map(lambda v: "" if v is None else str(v), r)) for r in (df.orderBy(*order) if order else df).collect()]
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + " --- |" * len(df.columns), *map(line, rows)]) + "\n"
