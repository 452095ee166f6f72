"""Rain features around storms: candidate cells, connected wet regions, and which of them belong.

Storms meet cells by an equi-join on the time step and a tile of latitude and longitude: each storm lists the tiles
that its window covers, over the seam at 0/360 and towards the poles, so that a time step's cells are compared with
near storms only, and the window and distance are checked on what is left. Only the labelling of connected cells, a walk within one storm's time step,
runs in numpy on grouped Arrow data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import LONGITUDES, RADIUS_KM, haversine_km, lon360, row_lat, row_lon, wrapped_delta
from ..functions.scalars import is_wet, rate
from ..session import ship

# Radii in km, km in a degree, least cosine and greatest half-width of the window.
OUTER_KM, CENTRE_KM = 1000.0, 500.0
DEGREE_KM, LEAST_COS, WIDEST = 111.0, 0.08, 170.0
TILE, TILE_LON = 5.0, 15.0


def met(tracks: DataFrame, fields: DataFrame, radius: float = OUTER_KM, precip: str = "PRECIP_3H_MM") -> DataFrame:
    """Storms with all cells of the tiles that their windows touch, and _half and _wide, the window's half sides in degrees.

    A storm without a position has no cells. A tile is listed once: a window is 340 degrees wide at most.
    """
    lat, lon, half = F.col("LAT").cast("double"), lon360(F.col("LON").cast("double")), radius / DEGREE_KM
    wide = F.least(F.lit(radius) / (DEGREE_KM * F.greatest(F.cos(F.radians(lat)), F.lit(LEAST_COS))), F.lit(WIDEST))
    tile = lambda c, size: F.floor(c / size).cast("int")
    t = tracks.where(F.col("LAT").isNotNull() & F.col("LON").isNotNull() & ~F.isnan(lat) & ~F.isnan(F.col("LON").cast("double")))
    t = t.withColumn("_half", F.lit(half)).withColumn("_wide", wide)
    t = t.withColumn("_i", F.explode(F.sequence(tile(lat - half, TILE), tile(lat + half, TILE))))
    t = t.withColumn("_j", F.explode(F.sequence(tile(lon - F.col("_wide"), TILE_LON), tile(lon + F.col("_wide"), TILE_LON)))).withColumn("_j", F.pmod("_j", F.lit(int(360 / TILE_LON))))
    f = fields.select("TIME", "ROW", precip, "IS_INTERPOLATED", row_lat("ROW").alias("GRID_LAT"), row_lon("ROW").alias("GRID_LON"))
    f = f.withColumn("_i", tile(F.col("GRID_LAT"), TILE)).withColumn("_j", tile(F.col("GRID_LON"), TILE_LON))
    return f.join(t, ["TIME", "_i", "_j"]).drop("_i", "_j")


def candidates(tracks: DataFrame, fields: DataFrame, radius: float = OUTER_KM, precip: str = "PRECIP_3H_MM") -> DataFrame:
    """Storms with the cells in their windows: all within radius/111 degrees of latitude, and of longitude by the storm's cosine.

    tracks: SID, TIME, LAT, LON and others, which stay; fields: TIME, ROW, precip, IS_INTERPOLATED. Adds
    GRID_LAT, GRID_LON, DLON (signed, from the storm) and DIST_KM. A storm without a position has no cells.
    """
    j = met(tracks, fields, radius, precip).withColumn("DLON", wrapped_delta("GRID_LON", lon360("LON")))
    j = j.where((F.abs(F.col("GRID_LAT") - F.col("LAT")) <= F.col("_half")) & (F.abs(F.col("DLON")) <= F.col("_wide"))).drop("_half", "_wide")
    return j.withColumn("DIST_KM", haversine_km("LAT", "LON", "GRID_LAT", "GRID_LON"))


def wet_cells(near: DataFrame, radius: float = OUTER_KM, precip: str = "PRECIP_3H_MM") -> DataFrame:
    """Wet candidates within the radius; missing, negative and infinite values are dry."""
    # plain on the column, so that it reaches the fields' files before the join
    return near.where(is_wet(precip) & (F.col("DIST_KM") <= radius))


def connected(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of 4-connected cells (i, j): for each cell the first cell of its region, in order of (i, j)."""
    order = np.lexsort((j, i))
    a, b = i[order], j[order]
    n = len(a)
    key = (a - a.min()).astype(np.int64) * (int(b.max() - b.min()) + 3) + (b - b.min())
    span = int(b.max() - b.min()) + 3
    links = []
    for step in (1, span):  # to the east, to the south
        at = np.searchsorted(key, key + step)
        ok = (at < n) & (key[np.minimum(at, n - 1)] == key + step)
        links.append(np.stack([np.flatnonzero(ok), at[ok]]))
    u, v = np.concatenate(links, axis=1)
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def labelled(wet: DataFrame, keys: tuple[str, ...] = ("SID", "TIME")) -> DataFrame:
    """`wet` with FEATURE, the ROW that names a cell's 4-connected region within each storm's time step.

    Columns are counted from the storm, so that neighbours over longitude 0 touch.
    """
    wet = wet.withColumn("_i", F.floor(F.col("ROW") / LONGITUDES).cast("long")).withColumn("_j", F.rint((F.col("DLON") + F.col("LON").cast("double")) * 10 - 0.5).cast("long"))
    light = wet.select(*keys, "ROW", "_i", "_j")

    def label(t: pa.Table) -> pa.Table:
        rows = t.column("ROW").to_numpy()
        first = connected(t.column("_i").to_numpy(), t.column("_j").to_numpy())
        return t.select([*keys, "ROW"]).append_column("FEATURE", pa.array(rows[first], pa.int32()))

    ship(wet.sparkSession)
    kinds = ", ".join(f"{k} {wet.schema[k].dataType.simpleString()}" for k in keys)
    names = light.groupBy(*keys).applyInArrow(label, f"{kinds}, ROW int, FEATURE int")
    return wet.drop("_i", "_j").join(names, [*keys, "ROW"])


def centred(features: DataFrame, centre: float = CENTRE_KM) -> DataFrame:
    """Whole features whose centroid (mean latitude, mean unwrapped longitude) is within `centre` km of the storm."""
    keys = ["SID", "TIME", "FEATURE"]
    c = features.groupBy(*keys).agg(F.avg("GRID_LAT").alias("_la"), F.avg("DLON").alias("_dl"), F.first("LAT").alias("_sla"), F.first("LON").alias("_slo"))
    c = c.where(haversine_km("_sla", "_slo", "_la", F.pmod(F.col("_slo") + F.col("_dl"), F.lit(360.0))) <= centre)
    return features.join(c.select(*keys), keys, "left_semi")


def attributed(tracks: DataFrame, fields: DataFrame, outer: float = OUTER_KM, centre: float = CENTRE_KM) -> DataFrame:
    """The cell table: wet cells of the features that belong to each storm's time step.

    Storms are taken one by one, so that a cell may belong to two storms at once. Cells of a storm's time step
    meet in one task, where regions are labelled and their centroids judged, so that fields are read and
    shuffled once.
    """
    wet = wet_cells(candidates(tracks, fields, outer), outer)
    f = "float"
    rows = wet.select(
        "SID", "TIME", F.year("TIME").cast("short").alias("YEAR"), "BASIN", F.col("LAT").cast(f).alias("TC_LAT"), lon360("LON").cast(f).alias("TC_LON_360"),
        F.col("GRID_LAT").cast(f).alias("GRID_LAT"), F.col("GRID_LON").cast(f).alias("GRID_LON"), F.col("PRECIP_3H_MM").cast(f).alias("PRECIP_3H_MM"),
        rate(F.col("PRECIP_3H_MM").cast(f)).cast(f).alias("PRECIP_MMHR"), F.col("IS_INTERPOLATED").alias("IS_INTERPOLATED_TIMESTEP"), "ROW",
        F.col("LAT").cast("double").alias("_lat"), F.col("LON").cast("double").alias("_lon"), F.col("GRID_LAT").alias("_glat"), F.col("DLON").alias("_dlon"),
        F.floor(F.col("ROW") / LONGITUDES).cast("long").alias("_i"), F.rint((F.col("DLON") + F.col("LON").cast("double")) * 10 - 0.5).cast("long").alias("_j"),
    )
    kept = rows.columns[: rows.columns.index("_lat")]

    def judge(t: pa.Table) -> pa.Table:
        glat, dlon = t.column("_glat").to_numpy(), t.column("_dlon").to_numpy()
        lat, lon = t.column("_lat")[0].as_py(), t.column("_lon")[0].as_py()
        _, own, n = np.unique(connected(t.column("_i").to_numpy(), t.column("_j").to_numpy()), return_inverse=True, return_counts=True)
        la, dl = (np.bincount(own, weights=x) / n for x in (glat, dlon))
        near = distance_km(lat, lon, la, (lon + dl) % 360) <= centre
        return t.select(kept).filter(pa.array(near[own]))

    ship(rows.sparkSession)
    return rows.groupBy("SID", "TIME").applyInArrow(judge, rows.select(*kept).schema)


def distance_km(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """`haversine_km` of one place and many, in numpy."""
    d = np.radians((lons - lon + 180) % 360 - 180)
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(d / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
