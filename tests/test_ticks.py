"""Ticks of tracks: their windows see the rows, and values are those between rows that have them."""

from datetime import datetime, timedelta

from pluvia.operators import tracks

T0 = datetime(2001, 1, 1)
SCHEMA = "SID string, TIME timestamp, LAT double, LON double, USA_WIND double, NAME string, NOTE string"


def rows():
    at = lambda h: T0 + timedelta(hours=h)
    return [
        ("a", at(0), 1.0, 359.0, None, None, "x"), ("a", at(6), 3.0, 1.0, 30.0, "N", "y"), ("a", at(12), 5.0, 3.0, None, None, "z"), ("a", at(18), 8.0, 6.0, 50.0, None, None),
        ("b", at(1), 0.0, 10.0, 10.0, "M", "p"), ("b", at(7), 6.0, 16.0, 16.0, None, "q"), (None, at(3), 4.0, 5.0, None, None, "only"), ("c", at(4), 4.0, 5.0, 1.0, "C", "off"),
    ]


def test_values_at_ticks(spark):
    got = {(r["SID"], (r["TIME"] - T0).total_seconds() / 3600): tuple(r)[2:] for r in tracks.interpolated(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {
        ("a", 0): (1.0, 359.0, None, "N", "x"), ("a", 3): (2.0, 0.0, None, "N", None), ("a", 6): (3.0, 1.0, 30.0, "N", "y"), ("a", 9): (4.0, 2.0, 35.0, "N", None),
        ("a", 12): (5.0, 3.0, 40.0, "N", "z"), ("a", 15): (6.5, 4.5, 45.0, "N", None), ("a", 18): (8.0, 6.0, 50.0, "N", None),
        ("b", 3): (2.0, 12.0, 12.0, "M", None), ("b", 6): (5.0, 15.0, 15.0, "M", None), (None, 3): (4.0, 5.0, None, None, "only"),
    }


def test_ticks_are_not_sorted(spark):
    """One sort, of the rows, and no aggregation of ticks: a task's memory follows the rows."""
    plan = tracks.interpolated(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert not any(x in above for x in ("Window", "Sort", "Aggregate", "Exchange"))
