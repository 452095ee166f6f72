"""Scalar rules of the data model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted units (compared in lower case and without spaces), band edges in degrees, wind cuts in knots.
UNITS = ("mm/3h", "mm/3hr", "mm/3hour", "mm 3h-1", "mm3h-1")
BANDS = {"NH": (0.0, 15.0, 25.0, 35.0, 90.0001), "SH": (0.0, 10.0, 15.0, 20.0, 90.0001)}
WIND_CUTS = ((33, "TD"), (63, "TS"), (82, "C1"), (95, "C2"), (112, "C3"), (136, "C4"))
STRONGEST = "C5"
BASIN_HEMISPHERE = {"WP": "NH", "EP": "NH", "NA": "NH", "NI": "NH", "SI": "SH", "SP": "SH"}
BASIN_NAMES = {"WP": "WNP", "EP": "EP", "NA": "NA", "NI": "NIO", "SI": "SIO", "SP": "SP"}
WET_MM_3H = 0.3
MINUS = "−"
DASH = "–"


def units_accepted(unit: Column | str) -> Column:
    c = F.col(unit) if isinstance(unit, str) else unit
    return F.coalesce(F.replace(F.lower(c), F.lit(" "), F.lit("")).isin(*(u.replace(" ", "") for u in UNITS)), F.lit(False))


def checked_units(unit: str | None) -> str:
    """The unit, normalised; an error if it is not an accumulation over three hours."""
    plain = (unit or "").lower().replace(" ", "")
    if plain not in {u.replace(" ", "") for u in UNITS}:
        raise ValueError(f"unit {unit!r} is not millimetres in three hours")
    return plain


def rate(accumulation: Column | str) -> Column:
    """mm in 3 h -> mm/h."""
    return (F.col(accumulation) if isinstance(accumulation, str) else accumulation) / 3


def hemisphere(lat: Column | str) -> Column:
    c = F.col(lat) if isinstance(lat, str) else lat
    return F.when(c >= 0, "NH").when(c < 0, "SH")


def band(lat: Column | str, hemi: Column | str) -> Column:
    """Band number by absolute latitude, lower edges included; -1 outside all bands."""
    a = F.abs((F.col(lat) if isinstance(lat, str) else lat).cast("double"))
    h = F.col(hemi) if isinstance(hemi, str) else hemi
    out = F.lit(None).cast("int")
    for name, edges in BANDS.items():
        own = F.lit(-1)
        for k in range(len(edges) - 2, -1, -1):
            own = F.when((a >= edges[k]) & (a < edges[k + 1]), k).otherwise(own)
        out = F.when(h == name, own).otherwise(out)
    return out


def band_labels(hemi: str, public: bool = True) -> list[str]:
    """Labels such as 0-15; the public form of the last one ends at 90."""
    edges = BANDS[hemi]
    top = lambda e: 90 if public and e > 90 else e
    return [f"{a:g}-{top(b):g}" for a, b in zip(edges, edges[1:], strict=False)]


def band_label(hemi: Column | str, index: Column | str, public: bool = True) -> Column:
    h, k = (F.col(x) if isinstance(x, str) else x for x in (hemi, index))
    out = F.lit(None).cast("string")
    for name in BANDS:
        out = F.when(h == name, F.get(F.array(*map(F.lit, band_labels(name, public))), k)).otherwise(out)
    return out


def intensity_category(wind: Column | str) -> Column:
    """TD, TS, C1..C5 by maximum wind in knots, upper edges included; null for null."""
    w = F.col(wind) if isinstance(wind, str) else wind
    out = F.when(w <= WIND_CUTS[0][0], WIND_CUTS[0][1])
    for cut, name in WIND_CUTS[1:]:
        out = out.when(w <= cut, name)
    return out.when(w.isNotNull() & ~F.isnan(w.cast("double")), STRONGEST)


def file_key(time: Column | str) -> Column:
    """Name of a time step's file: year and day of year, hour."""
    t = F.col(time) if isinstance(time, str) else time
    return F.format_string("%04d%03d.%02d.nc", F.year(t), F.dayofyear(t), F.hour(t))


def is_spur(track_type: Column | str) -> Column:
    c = F.col(track_type) if isinstance(track_type, str) else track_type
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("spur"))


def on_hours(time: Column | str, step: int) -> Column:
    """Whole hours divisible by `step`."""
    t = F.col(time) if isinstance(time, str) else time
    return (F.hour(t) % step == 0) & (F.minute(t) == 0) & (F.second(t) == 0)


def number_or_null(c: Column | str) -> Column:
    """A number from text; null if it is none (blank included), or not finite."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def dry_if_invalid(precip: Column | str) -> Column:
    """Missing, non-finite or negative precipitation counts as 0."""
    c = F.col(precip) if isinstance(precip, str) else precip
    ok = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    return F.when(ok, c).otherwise(F.lit(0).cast("float"))


def is_wet(precip: Column | str) -> Column:
    """Above 0.3 strictly, in single precision, as the field is stored."""
    c = (F.col(precip) if isinstance(precip, str) else precip).cast("float")
    return F.coalesce(~F.isnan(c) & (c < float("inf")) & (c > F.lit(WET_MM_3H).cast("float")), F.lit(False))


def exceeds(precip: Column | str, threshold: Column | str) -> Column:
    p, t = (F.col(x) if isinstance(x, str) else x for x in (precip, threshold))
    return F.coalesce(~F.isnan(t) & ~F.isnan(p) & (p > t), F.lit(False))


def ratio(a: Column | str, b: Column | str, empty: float | None = None) -> Column:
    """a / b; `empty` (or null) where b is 0."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    r = F.try_divide(x.cast("double"), y.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def is_significant(low: Column | str, high: Column | str) -> Column:
    """An interval that leaves out 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    return (a > 0) | (b < 0)


def clipped(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x), F.greatest(x, F.lit(0.0)))


def recoded_basin(c: Column | str) -> Column:
    """The North Atlantic's long code as NA, which is a basin and never a missing value."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x == "NATL", "NA").otherwise(x)


def display_basin(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in BASIN_NAMES.items() for v in kv)), x), x)


def shown(x: Column | str) -> Column:
    """Two decimals with a true minus sign, no negative zero, a dash for null."""
    c = F.col(x) if isinstance(x, str) else x
    r = F.round(c.cast("double"), 2) + 0.0
    text = F.format_string("%.2f", F.when(r == 0, F.lit(0.0)).otherwise(r))
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(DASH)).otherwise(F.replace(text, F.lit("-"), F.lit(MINUS)))


def shown_p(p: Column | str) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c.isNull(), F.lit(DASH)).when(c < 0.001, F.lit("p < 0.001")).otherwise(F.concat(F.lit("p = "), F.format_string("%.3f", c.cast("double"))))


def with_nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all float columns; to be applied where data come in."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes))


FILE_NAME = re.compile(r"(\d{4})(\d{3})\.(\d{2})\.nc")
