"""Precipitation fields: their calendar, which file stands for a time step, and replacement fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import file_key


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """TIME, NAME of every three-hour step of the years."""
    t = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{first:04d}-01-01 00:00:00', timestamp'{last:04d}-12-31 21:00:00', interval 3 hours)")).alias("TIME"))
    return t.select("TIME", file_key("TIME").alias("NAME"))


def index(listing: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """NAME, PATH: one file for each name; an override (of the same columns) goes before the source."""
    both = listing.select("NAME", "PATH", F.lit(1).alias("_p"))
    if overrides is not None:
        both = both.unionByName(overrides.select("NAME", "PATH", F.lit(0).alias("_p")))
    w = W.partitionBy("NAME").orderBy("_p", "PATH")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("NAME", "PATH")


def missing(names: DataFrame, found: DataFrame) -> DataFrame:
    """Names of the calendar without a file."""
    return names.join(found.select("NAME"), "NAME", "left_anti")


def complete_index(names: DataFrame, listing: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The index of all names, others ignored; a name without a file is an error when it is read."""
    i = names.select("NAME").join(index(listing, overrides), "NAME", "left")
    return i.withColumn("PATH", F.coalesce("PATH", F.raise_error(F.concat(F.lit("no file for "), "NAME"))))


def blended(before: DataFrame, after: DataFrame, weight_after: float, value: str = "PRECIP_3H_MM") -> DataFrame:
    """ROW, value: (1 - w) x before + w x after, in double precision and stored in single.

    Both must be full fields of the same cells: a cell that only one has is an error. A missing value
    on either side stays missing.
    """
    a, b = before.select("ROW", F.col(value).alias("_a")), after.select("ROW", F.col(value).alias("_b"))
    j = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), "ROW", "full_outer")
    ok = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    row = F.when(ok, F.col("ROW")).otherwise(F.raise_error(F.lit("fields of different cells")).cast("int"))
    return j.select(row.alias("ROW"), (F.col("_a").cast("double") * (1 - weight_after) + F.col("_b").cast("double") * weight_after).cast("float").alias(value))


def bracket_weight(before: str, target: str, after: str) -> float:
    """Weight of the later field at `target`, from ISO times that must be in order."""
    from datetime import datetime

    a, t, b = map(datetime.fromisoformat, (before, target, after))
    if not a < t < b:
        raise ValueError("the target must lie between the two fields")
    return (t - a) / (b - a)


def gaps(steps: DataFrame, have: DataFrame) -> DataFrame:
    """TIME, BEFORE, AFTER for each step of the calendar without a field: the nearest steps that have one, null at an end.

    Both windows go over the calendar, a row for each step, and not over fields.
    """
    known = steps.select("TIME").join(have.select("TIME").distinct().withColumn("_has", F.lit(True)), "TIME", "left")
    w = W.orderBy("TIME")
    there = F.when(F.col("_has"), F.col("TIME"))
    found = known.select("TIME", "_has", F.last(there, True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("BEFORE"), F.first(there, True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("AFTER"))
    return found.where("_has IS NULL").drop("_has")


def weights(plan: DataFrame) -> DataFrame:
    """The plan (TIME, BEFORE, AFTER) with WEIGHT_BEFORE and WEIGHT_AFTER, from the times; a time that is not strictly between the two is an error."""
    s = lambda c: F.unix_micros(c).cast("double")
    w = (s("TIME") - s("BEFORE")) / (s("AFTER") - s("BEFORE"))
    between = F.coalesce((F.col("BEFORE") < F.col("TIME")) & (F.col("TIME") < F.col("AFTER")), F.lit(False))
    w = F.when(between, w).otherwise(F.raise_error(F.lit("the target must lie between the two fields")).cast("double"))
    return plan.select("TIME", "BEFORE", "AFTER", w.alias("WEIGHT_AFTER")).select("TIME", "BEFORE", "AFTER", (1 - F.col("WEIGHT_AFTER")).alias("WEIGHT_BEFORE"), "WEIGHT_AFTER")


def replacements(fields: DataFrame, plan: DataFrame, value: str = "PRECIP_3H_MM") -> DataFrame:
    """TIME, ROW, value, IS_INTERPOLATED for each row (TIME, BEFORE, AFTER) of a plan.

    A plan whose time is not strictly between the two is an error, as is a cell that only one of the two
    fields has or that one has twice, a field that is not there, or a time that the plan has twice. Cells
    meet once for each two fields, by a shuffle of cells, and are then blended for all times between the two.
    Only the plan, a row for each step, is broadcast: a join by time would put a whole field into one task.
    """
    twice = F.count(F.lit(1)).over(W.partitionBy("TIME")) > 1
    steps = weights(plan).withColumn("_t", F.when(twice, F.raise_error(F.lit("a time is to be replaced twice")).cast("timestamp")).otherwise(F.col("TIME"))).drop("TIME")
    ends = F.array(F.struct(F.col("BEFORE").alias("TIME"), F.lit(True).alias("_first")), F.struct(F.col("AFTER").alias("TIME"), F.lit(False).alias("_first")))
    asked = plan.select("BEFORE", "AFTER").distinct().select("BEFORE", "AFTER", F.explode(ends).alias("_x")).select("BEFORE", "AFTER", "_x.*")
    have = fields.select("TIME").distinct().withColumn("_has", F.lit(True))
    first = F.when(F.col("_has"), F.col("_first")).otherwise(F.raise_error(F.lit("no field for a time of the plan")).cast("boolean"))
    asked = asked.join(have, "TIME", "left").select("TIME", "BEFORE", "AFTER", first.alias("_first"))
    found = fields.select("TIME", "ROW", F.col(value).cast("double").alias("_v")).join(F.broadcast(asked), "TIME")
    side = lambda x, f: f(F.when(F.col("_first") == x, F.col("_v")))
    n = lambda x: F.count(F.when(F.col("_first") == x, F.col("ROW")))
    both = found.groupBy("BEFORE", "AFTER", "ROW").agg(side(True, F.sum).alias("_a"), side(False, F.sum).alias("_b"), n(True).alias("_m"), n(False).alias("_n"))
    out = both.join(F.broadcast(steps), ["BEFORE", "AFTER"])
    whole = (F.col("_m") == 1) & (F.col("_n") == 1)
    v = F.when(whole, F.col("WEIGHT_BEFORE") * F.col("_a") + F.col("WEIGHT_AFTER") * F.col("_b")).otherwise(F.raise_error(F.lit("fields of different cells")).cast("double"))
    return out.select(F.col("_t").alias("TIME"), "ROW", v.cast("float").alias(value), F.lit(True).alias("IS_INTERPOLATED"))


# How a replacement was made.
METHOD = "linear interpolation in time, cell by cell"


def provenance(plan: DataFrame) -> DataFrame:
    """NAME, TIME, METHOD, SOURCE_BEFORE, SOURCE_AFTER, WEIGHT_BEFORE, WEIGHT_AFTER: where each replacement comes from."""
    return weights(plan).select(file_key("TIME").alias("NAME"), "TIME", F.lit(METHOD).alias("METHOD"), file_key("BEFORE").alias("SOURCE_BEFORE"), file_key("AFTER").alias("SOURCE_AFTER"), "WEIGHT_BEFORE", "WEIGHT_AFTER")


def overridden(fields: DataFrame, new: DataFrame) -> DataFrame:
    """Fields with the time steps of `new` replaced."""
    times = F.broadcast(new.select("TIME").distinct())
    return fields.join(times, "TIME", "left_anti").unionByName(new.select(*fields.columns))
