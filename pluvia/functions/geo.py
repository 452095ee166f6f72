"""Positions on the 0.1-degree grid, as column expressions inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
LATITUDES, LONGITUDES, STEP = 1800, 3600, 0.1


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def lon360(lon: Column | str) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(_c(lon).cast("double"), F.lit(360.0))


def display_lon(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon).cast("double") + 180.0, F.lit(360.0)) - 180.0


def wrapped_delta(lon: Column | str, ref: Column | str | float) -> Column:
    """Signed shortest way from `ref` to `lon`, in [-180, 180)."""
    return F.pmod(_c(lon).cast("double") - _c(ref) + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance; the shorter way over the date line."""
    rad = math.pi / 180
    p1, p2 = _c(lat1).cast("double") * rad, _c(lat2).cast("double") * rad
    half = F.sin((p2 - p1) / 2)
    side = F.sin(wrapped_delta(lon2, _c(lon1)) * rad / 2)
    a = half * half + F.cos(p1) * F.cos(p2) * side * side
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def grid_row(lat: Column | str, lon: Column | str) -> Column:
    """Cell number of a cell centre (row by row from the north); an error off the grid. Rounds half to even."""
    i = F.rint((F.lit(89.95) - _c(lat).cast("double")) / STEP)
    j = F.rint((lon360(lon) - 0.05) / STEP)
    inside = (i >= 0) & (i < LATITUDES) & (j >= 0) & (j < LONGITUDES)
    return F.when(inside, (i * LONGITUDES + j).cast("int")).when(_c(lat).isNotNull() & _c(lon).isNotNull(), F.raise_error(F.lit("coordinates outside the grid")).cast("int"))


def row_lat(row: Column | str) -> Column:
    return F.lit(89.95) - F.floor(_c(row) / LONGITUDES) * STEP


def row_lon(row: Column | str) -> Column:
    return F.pmod(_c(row), F.lit(LONGITUDES)) * STEP + 0.05


def degree_cell(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Centre of the 1-degree cell: (latitude, longitude in [0, 360))."""
    return F.floor(_c(lat).cast("double")) + 0.5, F.floor(lon360(lon)) + 0.5


def mask_position(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Where a land mask over [-90, 90] x [-180, 180) is read for a cell: clipped off the edges."""
    return F.greatest(F.lit(-89.999), F.least(F.lit(89.999), _c(lat).cast("double"))), F.greatest(F.lit(-179.999), F.least(F.lit(179.999), display_lon(lon)))
