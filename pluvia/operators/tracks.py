"""Storm tracks: raw positions to a regular three-hour table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geo import lon360, wrapped_delta
from ..functions.scalars import intensity_category, is_spur, number_or_null, on_hours

NUMBERS = ("LAT", "LON", "USA_WIND", "USA_PRES")
CARRIED = ("NAME", "BASIN", "USA_STATUS", "TRACK_TYPE")


def cleaned(raw: DataFrame) -> DataFrame:
    """Numbers and times from text (null if they are none); rows without SID, TIME, LAT or LON, and spur tracks, go."""
    rows = raw.withColumn("TIME", F.try_to_timestamp("ISO_TIME")).drop("ISO_TIME")
    rows = rows.withColumns({c: number_or_null(c) for c in NUMBERS if c in raw.columns})
    rows = rows.dropna(subset=["SID", "TIME", "LAT", "LON"]).where(~is_spur("TRACK_TYPE"))
    return rows.withColumn("LON", lon360("LON"))


def one_per_time(rows: DataFrame) -> DataFrame:
    """One row for each storm and time; of several the least by position, so that the choice is fixed."""
    w = W.partitionBy("SID", "TIME").orderBy(*(F.col(c).asc_nulls_last() for c in ("LAT", "LON", "USA_WIND", "USA_PRES") if c in rows.columns))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unwrapped(rows: DataFrame, out: str = "_u") -> DataFrame:
    """`out`: longitude without jumps, the first one plus the running sum of shortest steps."""
    w = W.partitionBy("SID").orderBy("TIME")
    step = F.coalesce(wrapped_delta("LON", F.lag("LON").over(w)), F.lit(0.0))
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_step", step).withColumn(out, F.first("LON").over(run) + F.sum("_step").over(run)).drop("_step")


def bracketed(value: str, at: Column, upto: W, after: W) -> tuple[Column, Callable[[str], Column]]:
    """The nearest values up to a row and after it, each with its time, and what makes of the two, by name, the value at `at`.

    Linear in time between them; null outside.
    """
    s = F.unix_micros("TIME").cast("double")
    mark = F.when(F.col(value).isNotNull(), F.struct(s.alias("s"), F.col(value).alias("v")))
    ends = F.struct(F.last(mark, ignorenulls=True).over(upto).alias("a"), F.first(mark, ignorenulls=True).over(after).alias("b"))

    def value_at(name: str) -> Column:
        a, b = F.col(f"{name}.a"), F.col(f"{name}.b")
        # multiplied first, so that whole numbers between whole numbers come out whole
        return F.when(a["s"] == at, a["v"]).otherwise(a["v"] + F.try_divide((b["v"] - a["v"]) * (at - a["s"]), b["s"] - a["s"]))

    return ends, value_at


def filled(value: str, upto: W, after: W) -> Column:
    """The last value up to a row, else the first one after."""
    return F.coalesce(F.last(value, ignorenulls=True).over(upto), F.first(value, ignorenulls=True).over(after))


def interpolated(anchors: DataFrame) -> DataFrame:
    """Anchors to whole three-hour ticks within each storm's life.

    Positions, wind and pressure are linear in time between values there are; names and codes are carried
    forward, then back; other columns stay as they are on ticks that are anchors, and are null on others.
    """
    return _ticked(unwrapped(one_per_time(anchors)))


def _ticked(rows: DataFrame) -> DataFrame:
    """`interpolated` of rows that are one for each storm and time, with their unwrapped longitude _u.

    Each row has the nearest values on either side, and gives the ticks from its time to before the next row's: windows and
    their sort see the rows, never the ticks.
    """
    hour3 = 3 * 3600
    own = [c for c in rows.columns if c not in ("SID", "TIME", "_u")]
    rows = rows.withColumn("TIME", F.col("TIME").cast("timestamp"))
    w = W.partitionBy("SID").orderBy("TIME")
    upto, after = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(1, W.unboundedFollowing)
    tick = lambda t: F.unix_micros(t) / 1_000_000 / hour3
    following = F.lead("TIME").over(w)
    first, stop = F.ceil(tick("TIME")), F.when(following.isNull(), F.floor(tick("TIME")) + 1).otherwise(F.ceil(tick(following)))
    at = (F.col("_t") * (hour3 * 1_000_000)).cast("double")
    here = F.unix_micros("TIME").cast("double") == at
    linear = {"LAT": "LAT", "LON": "_u"} | {c: c for c in ("USA_WIND", "USA_PRES") if c in own}
    ends = {c: bracketed(v, at, upto, after) for c, v in linear.items()}
    held = {f"_at_{c}": e for c, (e, _) in ends.items()} | {f"_at_{c}": filled(c, upto, after) for c in CARRIED if c in own}
    rows = rows.withColumns(held | {"_i": first.cast("long"), "_j": stop.cast("long")})
    rows = rows.withColumn("_t", F.explode(F.when(F.col("_i") < F.col("_j"), F.sequence("_i", F.col("_j") - 1, F.lit(1).cast("long")))))
    new = {c: value_at(f"_at_{c}") for c, (_, value_at) in ends.items()}
    new["LON"] = F.pmod(new["LON"], F.lit(360.0))
    new |= {c: F.col(f"_at_{c}") for c in CARRIED if c in own}
    others = {c: F.when(here, F.col(c)) for c in own if c not in new}
    return rows.select("SID", F.timestamp_seconds(F.col("_t") * hour3).alias("TIME"), *((new | others)[c].alias(c) for c in own))


def prepare(raw: DataFrame, first: int, last: int) -> DataFrame:
    """The track table: SID, TIME, positions, YEAR, MONTH, INTENSITY_CAT and the raw columns.

    Storms with positions at 0, 6, 12 or 18 UTC are interpolated from those alone; storms without any keep
    their own positions at whole three hours. No storm is too weak. The period is cut last.
    """
    # one shuffle by storm serves the choice of rows, the flags and the windows; dealt by number, since partitions joined by their
    # packed size are few, and large in memory
    n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = one_per_time(cleaned(raw).repartition(n, "SID"))
    storm = W.partitionBy("SID")
    rows = rows.withColumns({"_near": F.max(F.year("TIME").between(first, last)).over(storm), "_six": F.max(on_hours("TIME", 6)).over(storm)}).where("_near").drop("_near")
    rows = rows.where(F.when(F.col("_six"), on_hours("TIME", 6)).otherwise(on_hours("TIME", 3)))
    kept = [c for c in rows.columns if c != "_six"]
    out = _ticked(unwrapped(rows.where("_six").drop("_six"))).select(*kept).unionByName(rows.where("NOT _six").select(*kept))
    out = out.where(F.year("TIME").between(first, last))
    out = out.withColumns({"YEAR": F.year("TIME").cast("short"), "MONTH": F.month("TIME").cast("byte")})
    return out.withColumn("INTENSITY_CAT", intensity_category("USA_WIND") if "USA_WIND" in out.columns else F.lit(None).cast("string"))


def within(tracks: DataFrame, storms: list[str] | None = None, start: str | None = None, end: str | None = None, first_times: int | None = None) -> DataFrame:
    """Tracks of some storms, of a time range, or of the earliest time steps."""
    out = tracks
    if storms:
        out = out.where(F.col("SID").isin(*storms))
    if start:
        out = out.where(F.col("TIME") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("TIME") <= F.lit(end).cast("timestamp"))
    if first_times is not None:
        out = out.join(F.broadcast(out.select("TIME").distinct().orderBy("TIME").limit(first_times)), "TIME", "left_semi")
    return out
