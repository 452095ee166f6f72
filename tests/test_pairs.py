from pyspark.sql import functions as F

from pluvia.functions.geo import haversine_km
from pluvia.operators import pairs


def test_all_pairs_of_a_group_over_many_tasks(spark):
    """A group is not one task's work, and rows of one place, whatever their number, lose no pair."""
    a = spark.range(60).select("id", (F.col("id") % 2).alias("g"), F.lit(10.0).alias("a_lat"), (F.col("id") % 3 * 100).cast("double").alias("a_lon"))
    b = spark.range(1500).select(F.col("id").alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") % 2).alias("g"), (F.col("id") % 60).cast("double").alias("b_lat"), F.lit(359.0).alias("b_lon"))
    got = pairs.distances(a, b, "id", "k", "g", 4)
    want = a.join(b, "g").select("id", "k", F.round(haversine_km("a_lat", "a_lon", "b_lat", "b_lon"), 4).alias("km"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and max(r[1] for r in tasks) < want.count() / 4


def test_one_place(spark):
    """Lists are bounded, so that a place with many keys makes no long row."""
    a, b = (spark.range(n).select(F.col("id").alias(k), F.lit(0).alias("g"), F.lit(5.0).alias(f"{k}_lat"), F.lit(7.0).alias(f"{k}_lon")) for n, k in ((3, "a"), (2000, "b")))
    lists = pairs._gathered(b, "b", "g", "b_lat", "b_lon").select(F.size("b")).collect()
    assert max(r[0] for r in lists) <= pairs.KEYS and sum(r[0] for r in lists) == 2000
    assert pairs.distances(a, b, "a", "b", "g", 4).agg(F.count("*"), F.countDistinct("a", "b"), F.max("km")).first() == (6000, 6000, 0.0)


def test_first_row_leaves_before_other_lists(spark):
    """A task holds the pairs of two lists, not those of a list with its whole group, which grow with the tables."""
    a = spark.range(500).select("id", F.lit(0).alias("g"), (F.col("id") / 10).alias("a_lat"), F.lit(3.0).alias("a_lon"))
    b = spark.range(60).select(F.col("id").alias("k"), F.lit(0).alias("g"), F.lit(5.0).alias("b_lat"), F.lit(7.0).alias("b_lon"))
    got = pairs.distances(a, b, "id", "k", "g", 4)
    first = got.limit(1)
    assert len(first.collect()) == 1
    assert made(first._jdf.queryExecution().executedPlan()) == 60
    assert got.agg(F.count("*"), F.countDistinct("id", "k")).first() == (30000, 30000)


def made(plan) -> int:
    """Rows of the uppermost Generate."""
    name = plan.getClass().getSimpleName()
    if name == "GenerateExec":
        return plan.metrics().apply("numOutputRows").value()
    below = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else plan.children().head()
    return made(below)


def test_query_deals_a_group_over_tasks(spark, data):
    from pluvia.plans import records

    got = records.haversine_pairs(spark, f"{data}/sf0.01")
    assert len(got.groupBy(F.spark_partition_id()).count().collect()) > 8
