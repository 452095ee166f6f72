import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.functions import geo, normal, scalars


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_longitudes(spark):
    assert one(spark, geo.lon360(F.lit(-0.1)), geo.lon360(F.lit(360.0)), geo.wrapped_delta(F.lit(1.0), 359.0), geo.display_lon(F.lit(180.0))) == pytest.approx((359.9, 0.0, 2.0, -180.0))
    assert one(spark, geo.haversine_km(F.lit(20.0), F.lit(359.0), F.lit(20.0), F.lit(1.0)))[0] < 500
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] == pytest.approx(math.pi * 6371)


def test_rows(spark):
    df = spark.createDataFrame([(89.95, 0.05), (0.05, 180.05), (-89.95, 359.95), (-89.95, -0.05)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.grid_row("lat", "lon")).collect()] == [0, 3238200, 6479999, 6479999]
    with pytest.raises(Exception, match="outside the grid"):
        spark.createDataFrame([(95.0, 0.0)], "lat double, lon double").select(geo.grid_row("lat", "lon")).collect()
    assert one(spark, geo.row_lat(F.lit(3238200)), geo.row_lon(F.lit(3238200))) == pytest.approx((0.05, 180.05))


def test_bands(spark):
    df = spark.createDataFrame([("NH", x, k) for x, k in ((0.0, 0), (14.999, 0), (15.0, 1), (25.0, 2), (35.0, 3), (90.0, 3))] + [("SH", x, k) for x, k in ((0.0, 0), (-9.999, 0), (-10.0, 1), (-15.0, 2), (-20.0, 3), (-91.0, -1))], "h string, x double, k int")
    assert df.where(scalars.band("x", "h") != F.col("k")).count() == 0
    assert scalars.band_labels("NH") == ["0-15", "15-25", "25-35", "35-90"] and scalars.band_labels("SH", public=False)[3] == "20-90.0001"


def test_wet_is_strict_in_single_precision(spark):
    df = spark.createDataFrame([(0.31, True), (0.3, False), (float("nan"), False), (float("inf"), False), (None, False), (float(np.nextafter(np.float32(0.3), np.float32(1))), True)], "p float, wet boolean")
    assert df.where(scalars.is_wet("p") != F.col("wet")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(None,), (-1.0,), (float("nan"),), (2.0,)], "p float").select(scalars.dry_if_invalid("p")).collect()] == [0, 0, 0, 2]


def test_categories_units_numbers(spark):
    cuts = {None: None, 33.0: "TD", 33.5: "TS", 63.0: "TS", 82.0: "C1", 95.0: "C2", 112.0: "C3", 136.0: "C4", 137.0: "C5"}
    df = spark.createDataFrame(list(cuts.items()), "w double, c string")
    assert df.where(~scalars.intensity_category("w").eqNullSafe(F.col("c"))).count() == 0
    assert one(spark, scalars.units_accepted(F.lit("MM / 3h")), scalars.units_accepted(F.lit("mm/h")), scalars.units_accepted(F.lit(None).cast("string"))) == (True, False, False)
    with pytest.raises(ValueError):
        scalars.checked_units("mm/h")
    assert one(spark, *(scalars.shown(F.lit(x).cast("double")) for x in (-0.001, -1.234, 2.0, None))) == ("0.00", "−1.23", "2.00", "–")
    assert one(spark, *(scalars.shown_p(F.lit(x).cast("double")) for x in (0.0001, 0.0365, None)))[::2] == ("p < 0.001", "–")
    assert one(spark, scalars.number_or_null(F.lit(" ")), scalars.number_or_null(F.lit("1e3")), scalars.number_or_null(F.lit("nan"))) == (None, 1000.0, None)
    assert one(spark, scalars.ratio(F.lit(1), F.lit(0)), scalars.ratio(F.lit(1), F.lit(0), 0.0), scalars.display_basin(F.lit("NI")), scalars.display_basin(F.lit("SA")), scalars.recoded_basin(F.lit("NATL"))) == (None, 0.0, "NIO", "SA", "NA")


def test_erfc(spark):
    xs = [0.0, 0.01, 0.5, 1.0, 2.49, 2.5, 3.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").orderBy("x").select(normal.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-10)


def test_nan_becomes_null(spark):
    df = scalars.with_nulls_for_nan(spark.createDataFrame([(1, float("nan")), (2, 1.5)], "i int, x double"))
    assert [tuple(r) for r in df.orderBy("i").collect()] == [(1, None), (2, 1.5)]
