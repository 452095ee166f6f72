"""Events and histograms from a stream of cells.

`event_stream` keeps sums and counts of a storm's time step in Spark's state store, closed by a watermark: cells that
come later than that are lost to it. `keep_extreme` loses none: each micro-batch's cells are written under its
batch number, a cell that comes again replaces what was there, and events are made of all cells so far, so
that they are those of one batch over everything; `revised` gives the events that some batches changed. A batch that is
run again, after a failure, replaces its own files, and counts stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import hemisphere
from ..operators.events import build_events
from ..operators.thresholds import from_histogram, histogram

CELL = ("SID", "TIME", "ROW")


def event_stream(extreme: DataFrame, lateness: str = "6 hours", precip: str = "PRECIP_3H_MM", flag: str = "IS_INTERPOLATED_TIMESTEP") -> DataFrame:
    """A stream of events from a stream of extreme cells (TIME a timestamp); append or update mode."""
    steps = extreme.withWatermark("TIME", lateness).groupBy("SID", F.window("TIME", "3 hours").alias("w"))
    e = steps.agg(F.min("BASIN").alias("BASIN"), F.min("TC_LAT").alias("TC_LAT"), F.avg(F.col(precip).cast("double")).alias("EVENT_INTENSITY_MM_3H"), F.count(F.lit(1)).alias("N_EXTREME_CELLS"), F.max(flag).alias(flag))
    return e.select("SID", F.col("w.start").alias("TIME"), F.year("w.start").alias("YEAR"), hemisphere("TC_LAT").alias("HEMISPHERE"), "BASIN", "TC_LAT", "EVENT_INTENSITY_MM_3H", "N_EXTREME_CELLS", flag)


def histogram_stream(cells: DataFrame, path: str, checkpoint: str, value: str = "PRECIP_3H_MM", **trigger) -> StreamingQuery:
    """Keeps histograms of a stream of cells below `path`, one folder a batch; start of the running query."""

    def keep(batch: DataFrame, number: int) -> None:
        histogram(batch, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = cells.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(**trigger) if trigger else out).start()


def keep_extreme(extreme: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the extreme cells of a stream below `path`, one folder a batch; start of the running query."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = extreme.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(**trigger) if trigger else out).start()


def cells_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Kept cells, each once: of cells that came more than once that of the latest batch, and in it the greatest."""
    kept = spark.read.parquet(path)
    rest = [c for c in kept.columns if c not in (*CELL, "batch")]
    last = kept.groupBy(*CELL).agg(F.max(F.struct("batch", *rest)).alias("_x"), F.min("batch").alias("first_batch"))
    return last.select(*CELL, "_x.*", "first_batch")


def events_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The events of all kept cells."""
    return build_events(cells_so_far(spark, path))


def revised(spark: SparkSession, path: str, since: int) -> DataFrame:
    """Events that batches from number `since` on made or changed, as they are now; NEW if no earlier batch had cells of them."""
    cells = cells_so_far(spark, path)
    touched = cells.groupBy("SID", "TIME").agg(F.max("batch").alias("_b"), (F.min("first_batch") >= since).alias("NEW")).where(F.col("_b") >= since)
    return build_events(cells).join(touched.drop("_b"), ["SID", "TIME"])


def stored_histogram(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all batches so far: ROW, BIN, N."""
    return spark.read.parquet(path).groupBy("ROW", "BIN").agg(F.sum("N").alias("N"))


def current_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return from_histogram(stored_histogram(spark, path))
