"""Moving-block bootstrap of trends: all replicates of a domain are one matrix.

A domain's annual table (years, or years and bands) meets in one task, in one shuffle. There its replicates are drawn by
numpy's generator, so that they can be repeated bit by bit, and slopes are medians along an axis of a matrix of
pairs; the matrix is made for some replicates at a time. What leaves the task is the intervals.
`replicates` gives the points of every replicate as rows, for other statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from . import trend
from .decompose import annual_series, long_components
from .slopes import median_slope

REPETITIONS, BLOCK_YEARS, SEED = 1000, 4, 42
LEVELS = (0.025, 0.975)


def block_draws(length: int, block: int, repetitions: int, seed: int) -> np.ndarray:
    """repetitions x length positions: overlapping blocks from uniform starts, cut to the series' length."""
    if not 1 <= block <= length:
        raise ValueError(f"blocks of {block} do not fit a series of {length}")
    rng = np.random.default_rng(seed)
    n = -(-length // block)
    starts = np.stack([rng.integers(0, length - block + 1, size=n) for _ in range(repetitions)])
    return (starts[:, :, None] + np.arange(block)).reshape(repetitions, -1)[:, :length]


def draws(spark: SparkSession, lengths: Sequence[int], block: int, repetitions: int, seed: int) -> DataFrame:
    """n, REP, src: for each length the positions that each replicate's residuals come from."""
    rows = [(n, r, d.tolist()) for n in lengths for r, d in enumerate(block_draws(n, block, repetitions, seed))]
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return spark.createDataFrame(pa.table({"n": pa.array(cols[0], pa.int32()), "REP": pa.array(cols[1], pa.int32()), "src": pa.array(cols[2], pa.list_(pa.int32()))}))


def replicates(df: DataFrame, keys: Sequence[str], y: str, t: str = "YEAR", joint: bool = True, block: int = BLOCK_YEARS, repetitions: int = REPETITIONS, seed: int = SEED, floor: float | None = None, lengths: Sequence[int] | None = None) -> DataFrame:
    """keys, REP, p: the points (t, y*) of every replicate, y* = fit + residual at the drawn position.

    A series of n points uses the draws for n, the same for every series of that length. `lengths` names
    the lengths there are; without it a job finds them. Missing or non-finite values are an error.
    """
    v = F.col(y).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.raise_error(F.lit("a series to be resampled has missing or infinite values")).cast("double"))
    line = trend.sen_line(df.withColumn(y, v), list(keys), y, t, joint)
    one = F.struct(F.col(t).cast("double").alias("t"), "fit", "residual")
    series = line.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("q")).withColumn("n", F.size("q"))
    if lengths is None:
        lengths = sorted(r["n"] for r in series.select("n").distinct().collect())
    drawn = series.join(draws(df.sparkSession, lengths, block, repetitions, seed), "n")
    star: Column = F.transform("q", lambda x, i: F.struct(x["t"].alias("t"), (x["fit"] + F.get("q", F.get("src", i))["residual"]).alias("y")))
    if floor is not None:
        star = F.transform(star, lambda x: F.struct(x["t"].alias("t"), F.greatest(x["y"], F.lit(floor)).alias("y")))
    return drawn.select(*keys, "REP", star.alias("p"))


#: Cells of a matrix of pairs that is held at once.
CELLS = 1 << 21


def _slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sen slopes of the rows of y, over the times t; NaN values are left out, and fewer than three others give NaN."""
    if y.shape[1] > trend.PAIRWISE:
        return np.array([_slope(t, x) for x in y])
    i, j = np.triu_indices(len(t), 1)
    i, j = i[t[i] < t[j]], j[t[i] < t[j]]
    out = np.full(len(y), np.nan)
    whole = np.isfinite(y).all(axis=1)
    if len(t) >= 3 and len(i):
        at, step = np.flatnonzero(whole), max(1, CELLS // len(i))
        for k in range(0, len(at), step):
            x = y[at[k : k + step]]
            out[at[k : k + step]] = np.median((x[:, j] - x[:, i]) / (t[j] - t[i]), axis=1)
    for k in np.flatnonzero(~whole):
        out[k] = _slope(t, y[k])
    return out


def _slope(t: np.ndarray, y: np.ndarray) -> float:
    ok = np.isfinite(y)
    found = median_slope(t[ok], y[ok]) if ok.sum() >= 3 else None
    return np.nan if found is None else found


def _lines(t: np.ndarray, y: np.ndarray, joint: bool) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, fits) of the Sen lines of the rows of y; a joint line without a slope is flat."""
    m = _slopes(t, y)
    if joint:
        m = np.where(np.isnan(m), 0.0, m)
        level = np.median(y - m[:, None] * t, axis=1)
    else:
        level = np.median(y, axis=1) - m * np.median(t)
    return m, level[:, None] + m[:, None] * t


def _by_domain(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fn: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """fn's columns for each domain, whose rows it gets sorted by the first of `columns`; keys are put before them."""
    ship(df.sparkSession)
    of = StructType([*df.select(*keys).schema.fields, *StructType.fromDDL(schema).fields])
    names = [f.name for f in of.fields[len(keys) :]]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([(c, "ascending") for c in columns[:2]])
        found = fn(t)
        n = len(found[names[0]])
        own = [pa.repeat(t.column(k)[0], n) for k in keys]
        return pa.table([*own, *(pa.array(np.asarray(found[c]), from_pandas=True) for c in names)], names=[*keys, *names])

    return df.select(*keys, *columns).groupBy(*keys).applyInArrow(run, of)


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    """Values as doubles; one that is missing or infinite is an error."""
    x = t.column(column).to_numpy().astype(float)
    if not np.isfinite(x).all():
        raise ValueError("a series to be resampled has missing or infinite values")
    return x


def _resampled(t: np.ndarray, y: np.ndarray, joint: bool, draws: np.ndarray) -> np.ndarray:
    """A row for each draw: the Sen line, and the residuals from the drawn places."""
    _, fit = _lines(t, y[None, :], joint)
    return fit + (y - fit[0])[draws]


def trend_intervals(df: DataFrame, keys: Sequence[str], y: str, t: str = "YEAR", joint: bool = True, block: int = BLOCK_YEARS, repetitions: int = REPETITIONS, seed: int = SEED) -> DataFrame:
    """keys, ci_low, ci_high of the slope by decade."""

    def interval(points: pa.Table) -> dict:
        x = _numbers(points, t)
        star = _resampled(x, _numbers(points, y), joint, block_draws(len(x), block, repetitions, seed))
        low, high = np.quantile(10 * _slopes(x, star), LEVELS)
        return {"ci_low": [low], "ci_high": [high]}

    return _by_domain(df.where(F.col(t).isNotNull()), keys, [t, y], interval, "ci_low double, ci_high double")


def component_intervals(parts: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    """keys, COMPONENT, ci_low, ci_high; the components of a replicate share their draw."""
    return trend_intervals(long_components(parts, keys), [*keys, "COMPONENT"], "value", joint=False, **how)


def fit_bands(df: DataFrame, keys: Sequence[str], y: str, t: str = "YEAR", joint: bool = True, block: int = BLOCK_YEARS, repetitions: int = REPETITIONS, seed: int = SEED) -> DataFrame:
    """keys, t, fit, fit_lower, fit_upper: the Sen line and the interval of the replicates' lines."""

    def band(points: pa.Table) -> dict:
        x, v = _numbers(points, t), _numbers(points, y)
        star = _resampled(x, v, joint, block_draws(len(x), block, repetitions, seed))
        low, high = np.quantile(_lines(x, star, joint)[1], LEVELS, axis=0)
        return {t: points.column(t).to_numpy(), "fit": _lines(x, v[None, :], joint)[1][0], "fit_lower": low, "fit_upper": high}

    return _by_domain(df.where(F.col(t).isNotNull()), keys, [t, y], band, f"{t} {df.schema[t].dataType.simpleString()}, fit double, fit_lower double, fit_upper double")


TERMS = ("migration", "intensity", "residual", "total")


def _terms(t: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """`band_terms` of replicates: n and v by (replicate, year, band) to (term, replicate, band)."""

    def over(a: np.ndarray, b: np.ndarray, otherwise: float) -> np.ndarray:
        return np.divide(a, b, out=np.full(np.broadcast_shapes(a.shape, b.shape), otherwise), where=b != 0)

    def slopes(x: np.ndarray) -> np.ndarray:
        s = _slopes(t, x.transpose(0, 2, 1).reshape(-1, len(t))).reshape(len(x), -1)
        return 10 * np.where(np.isnan(s), 0.0, s)

    count = n.sum(axis=2, keepdims=True)
    share, mean, part = over(n, count, 0.0), over(v, n, np.nan), over(v, count, 0.0)
    known = np.isfinite(mean)
    usual = over(np.where(known, mean, 0.0).sum(axis=1), known.sum(axis=1).astype(float), 0.0)
    migration, intensity, total = slopes(share) * usual, share.mean(axis=1) * slopes(mean), slopes(part)
    return np.stack([migration, intensity, total - migration - intensity, total])


def band_intervals(bands: DataFrame, keys: Sequence[str], n: str = "N_EVENTS", total: str = "INTENSITY_SUM", block: int = BLOCK_YEARS, repetitions: int = REPETITIONS, seed: int = SEED) -> DataFrame:
    """keys, BAND, each term of `band_terms` as _point, _ci_low, _ci_high.

    Counts and sums of a band are detrended by themselves, resampled with one draw for the replicate,
    held at 0 or more, and decomposed again. The table must have every band in every year of its domain.
    """
    names = [f"{c}_{e}" for e in ("point", "ci_low", "ci_high") for c in TERMS]

    def intervals(rows: pa.Table) -> dict:
        years, which = (np.unique(rows.column(c).to_numpy()) for c in ("YEAR", "BAND"))
        shape = len(years), len(which)
        if rows.num_rows != shape[0] * shape[1] or (rows.column("BAND").to_numpy().reshape(shape) != which).any():
            raise ValueError("a band table to be resampled has gaps or repeated rows")
        t = years.astype(float)
        own = [_numbers(rows, c).reshape(shape) for c in (n, total)]
        drawn = block_draws(len(t), block, repetitions, seed)
        found, step = [], max(1, CELLS // (len(t) * len(t) * shape[1]))
        for k in range(0, repetitions, step):
            star = [np.stack([np.maximum(_resampled(t, x[:, b], True, drawn[k : k + step]), 0.0) for b in range(shape[1])], axis=2) for x in own]
            found.append(_terms(t, *star))
        low, high = np.quantile(np.concatenate(found, axis=1), LEVELS, axis=1)
        point = _terms(t, own[0][None], own[1][None])[:, 0]
        return {"BAND": which, **dict(zip(names, [*point, *low, *high], strict=True))}

    kind = bands.schema["BAND"].dataType.simpleString()
    out = _by_domain(bands, keys, ["YEAR", "BAND", n, total], intervals, ", ".join([f"BAND {kind}", *(f"{c} double" for c in names)]))
    return out.select(*keys, "BAND", *(f"{c}_point" for c in TERMS), *(f"{c}_{e}" for c in TERMS for e in ("ci_low", "ci_high")))


def mean_fit_bands(bands: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    """`fit_bands` of the annual mean; with the same seed its draws are those of `band_intervals`."""
    return fit_bands(annual_series(bands, keys), keys, "mean", **how)
