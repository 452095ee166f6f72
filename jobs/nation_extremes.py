"""Annual extremes by domain: which events exceed their domain's local percentile, and how their share changes.

    python -m jobs.nation_extremes --source DIR --output DIR [--config FILE] [--master URL]

Reads the tables orders (events with an intensity, o_totalprice, and a time), customer, nation and region
below DIR. A domain is a nation. Its threshold is the exact nearest-rank percentile of its events in all years;
events strictly above are extreme. For each domain and year: events, extreme events, their mean and share; for
each domain: slope by decade and Mann-Kendall's p of the share. Events whose customer or nation is
not known form the domain UNKNOWN of the region UNKNOWN, and events outside the years are not read.

The output is Parquet by REGION and YEAR; a run replaces the partitions that it makes, so that it can be repeated, also
after a failure, with the same result. With `strict`, input with null or repeated keys is an error and nothing is
written.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.scalars import exceeds, ratio
from pluvia.operators import audit, bands, selection, trend
from pluvia.session import session
from pluvia.sources.tables import table

log = logging.getLogger("jobs.nation_extremes")
CONFIG = Path(__file__).with_suffix(".json")
UNKNOWN = "UNKNOWN"


def placed_events(spark: SparkSession, source: str, first: int, last: int) -> DataFrame:
    """o_orderkey, REGION, DOMAIN, YEAR, VALUE of every event of the years."""
    from_, to = (F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp") for y in (first, last + 1))
    orders = table(spark, source, "orders").where((F.col("o_orderdate") >= from_) & (F.col("o_orderdate") < to))
    places = table(spark, source, "nation").join(table(spark, source, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    places = places.select("n_nationkey", F.coalesce("n_name", F.lit(UNKNOWN)).alias("DOMAIN"), F.coalesce("r_name", F.lit(UNKNOWN)).alias("REGION"))
    homes = table(spark, source, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    e = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"), "left")
    return e.select("o_orderkey", F.coalesce("REGION", F.lit(UNKNOWN)).alias("REGION"), F.coalesce("DOMAIN", F.lit(UNKNOWN)).alias("DOMAIN"), F.year("o_orderdate").alias("YEAR"), F.col("o_totalprice").cast("double").alias("VALUE"))


def checks(spark: SparkSession, source: str) -> DataFrame:
    """check, failures of the tables' keys."""
    orders, customers, nations = (table(spark, source, n) for n in ("orders", "customer", "nation"))
    nulls = audit.counted(orders, {"null event": F.col("o_orderkey").isNotNull(), "null time": F.col("o_orderdate").isNotNull()})
    repeated = [audit.duplicates(df.where(F.col(k).isNotNull()), [k], f"repeated {k}") for df, k in ((orders, "o_orderkey"), (customers, "c_custkey"), (nations, "n_nationkey"))]
    for x in repeated:
        nulls = nulls.unionByName(x)
    return nulls


def annual_extremes(events: DataFrame, quantile: float, first: int, last: int) -> DataFrame:
    """REGION, DOMAIN, YEAR, N_EVENTS, N_EXTREME, THRESHOLD, MEAN_EXTREME, SHARE, SLOPE, P_VALUE on all years."""
    keys = ["REGION", "DOMAIN"]
    local = selection.nearest_rank(events, keys, "VALUE", quantile, "THRESHOLD").select(*keys, "THRESHOLD")
    over = events.join(local, keys, "left").withColumn("_x", F.coalesce(exceeds("VALUE", "THRESHOLD"), F.lit(False)))
    sums = over.groupBy(*keys, "YEAR").agg(F.count(F.lit(1)).alias("N_EVENTS"), F.count_if("_x").alias("N_EXTREME"), F.sum(F.when(F.col("_x"), F.col("VALUE"))).alias("_v"))
    dense = bands.densified(sums, keys, (first, last), {"N_EVENTS": F.lit(0), "N_EXTREME": F.lit(0)}, bands=False)
    dense = dense.join(local, keys, "left").select(*keys, "YEAR", "N_EVENTS", "N_EXTREME", "THRESHOLD", ratio("_v", "N_EXTREME").alias("MEAN_EXTREME"), ratio(F.col("N_EXTREME"), F.col("N_EVENTS")).alias("SHARE"))
    changes = trend.trends(dense, keys, "SHARE").select(*keys, F.col("slope").alias("SLOPE"), F.col("p_value").alias("P_VALUE"))
    return dense.join(changes, keys)


def run(spark: SparkSession, source: str, output: str, quantile: float = 0.99, first: int = 1995, last: int = 2001, strict: bool = True) -> DataFrame:
    """Writes the annual table below `output` and returns it as read back."""
    bad = [(r["check"], r["failures"]) for r in checks(spark, source).where("failures > 0").collect()]
    for name, n in bad:
        log.warning("%s: %d rows of %s", name, n, source)
    if bad and strict:
        raise ValueError(f"the input fails {bad}")
    for name in ("orders", "customer", "nation", "region"):
        log.info("read %s/%s.parquet: %d rows", source, name, table(spark, source, name).count())
    out = annual_extremes(placed_events(spark, source, first, last), quantile, first, last)
    # a few rows a year and domain: one file for each partition
    out = out.repartition("REGION", "YEAR").sortWithinPartitions("REGION", "YEAR", "DOMAIN")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("REGION", "YEAR").parquet(output)
    done = spark.read.parquet(output)
    log.info("wrote %s: %d rows in %d partitions", output, done.count(), done.select("REGION", "YEAR").distinct().count())
    return done


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--source", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(a.master)
    try:
        run(spark, a.source, a.output, **json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
