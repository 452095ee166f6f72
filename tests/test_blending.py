"""Replacement fields: no task gets a whole field, and fields that do not match are errors."""

from datetime import datetime

import pytest

from pluvia.operators import fields

A, B, C, D = (datetime(2001, 1, 1, h) for h in (0, 3, 6, 9))
FIELD, PLAN = "TIME timestamp, ROW int, PRECIP_3H_MM float", "TIME timestamp, BEFORE timestamp, AFTER timestamp"


def blended(spark, rows, plan):
    return fields.replacements(spark.createDataFrame(rows, FIELD), spark.createDataFrame(plan, PLAN))


def test_several_times_between_two_fields(spark):
    rows = [(A, r, 9.0 * r) for r in range(50)] + [(D, r, None if r == 7 else 3.0) for r in range(50)]
    got = {(r["TIME"], r["ROW"]): r["PRECIP_3H_MM"] for r in blended(spark, rows, [(B, A, D), (C, A, D)]).collect()}
    assert len(got) == 100 and got[B, 7] is None and got[C, 7] is None
    assert [got[B, 1], got[C, 1], got[B, 4]] == pytest.approx([7.0, 5.0, 25.0])


def test_fields_stay_in_their_tasks(spark):
    """Only the plan is sent around, at any size of either."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blended(spark, [(A, 1, 1.0), (D, 1, 2.0)], [(B, A, D)])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [TIME" in plan


@pytest.mark.parametrize(
    ("rows", "plan", "says"),
    [
        ([(A, 1, 1.0), (D, 1, 2.0), (D, 2, 2.0)], [(B, A, D)], "different cells"),
        ([(A, 1, 1.0), (A, 1, 1.0), (D, 2, 1.0), (D, 2, 1.0)], [(B, A, D)], "different cells"),  # twice in one, in the other not at all
        ([(A, None, 1.0), (D, None, 1.0)], [(B, A, D)], "different cells"),
        ([(A, 1, 1.0), (D, 1, 2.0)], [(B, A, C)], "no field"),
        ([(C, 1, 1.0)], [(B, A, D)], "no field"),
        ([], [(B, A, D)], "no field"),
        ([(A, 1, 1.0), (D, 1, 2.0)], [(B, A, D), (B, A, D)], "twice"),
        ([(A, 1, 1.0), (D, 1, 2.0)], [(D, A, D)], "between the two"),
    ],
)
def test_refused(spark, rows, plan, says):
    with pytest.raises(Exception, match=says):
        blended(spark, rows, plan).collect()
