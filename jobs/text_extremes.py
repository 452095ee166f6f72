"""Extreme texts by source, kept up to date: which documents are longer than their source's local percentile.

    python -m jobs.text_extremes --source PATH --output DIR --checkpoint DIR [--config FILE] [--master URL]

PATH is a growing Parquet table of documents (doc_id, text, lang, source): a folder to which files are added, or a
pattern of folders and files. A run takes the files that no run has taken before, by a file stream with a checkpoint, and keeps of each document a
small sample: its id, source, language and number of words. Then thresholds (the exact nearest-rank
percentile of all samples of a source, as for cells and their wet values) and the documents strictly
above them are made anew from the samples, because a threshold moves with every new document.

Samples lie below the checkpoint, a folder for each micro-batch: a batch that is run again after a failure
replaces its own folder, so that no document counts twice. The output is Parquet by SHELF, the source in a form
that a folder's name can have. It depends on the samples alone: a run without new files writes the same rows again.

A null text has no words. A null source is one of its own; its shelf is `none`.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators import selection
from pluvia.session import session

log = logging.getLogger("jobs.text_extremes")
CONFIG = Path(__file__).with_suffix(".json")
SAMPLES = "doc_id long, source string, lang string, words long"
OUTPUT = "doc_id long, source string, lang string, words long, threshold long, n long, SHELF string"


def sampled(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words.alias("words"))


def take_new(spark: SparkSession, source: str, checkpoint: str, files_per_batch: int) -> int:
    """Samples of the files that are new; how many rows they had. Returns when the stream has ended."""
    schema = spark.read.parquet(source).schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}/samples/batch={number}")

    new = sampled(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    query = new.writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %s: %d new rows", source, rows)
    return rows


def samples(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All samples so far."""
    try:
        return spark.read.schema(f"{SAMPLES}, batch long").parquet(f"{checkpoint}/samples").drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SAMPLES)


def extremes(known: DataFrame, quantile: float) -> DataFrame:
    """doc_id, source, lang, words, threshold, n, SHELF of the documents above their source's threshold; n is the source's documents."""
    local = selection.nearest_rank(known, ["source"], "words", quantile, "threshold").withColumnRenamed("source", "_source")
    over = known.join(local, known["source"].eqNullSafe(local["_source"]) & (F.col("words") > F.col("threshold")))
    safe = F.regexp_replace("source", "[^A-Za-z0-9._-]", "_")
    shelf = F.when(F.col("source").isNull(), "none").otherwise(F.concat(F.lit("s-"), safe))
    return over.select("doc_id", "source", "lang", "words", "threshold", "n", shelf.alias("SHELF"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, quantile: float = 0.9, files_per_batch: int = 64) -> DataFrame:
    """Takes what is new, writes the extreme texts of all that was ever taken, and returns them as read back."""
    take_new(spark, source, checkpoint, files_per_batch)
    known = samples(spark, checkpoint)
    found = extremes(known, quantile)
    found.repartition("SHELF").sortWithinPartitions("SHELF", "doc_id").write.mode("overwrite").partitionBy("SHELF").parquet(output)
    done = spark.read.schema(OUTPUT).parquet(output)
    log.info("wrote %s: %d rows of %d samples in %d partitions", output, done.count(), known.count(), done.select("SHELF").distinct().count())
    return done


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--source", "--output", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(a.master)
    try:
        run(spark, a.source, a.output, a.checkpoint, **json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
