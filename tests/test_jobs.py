"""The jobs: two runs over growing input, reruns, and what they say."""

import json
import logging
import math
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import nation_extremes, queries, text_extremes
from tests.conftest import ROOT

from .test_queries import TABLES, con, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, con, name):  # noqa: F811
    df = queries.QUERIES[name](spark, f"{data}/sf0.001")
    want = con.sql(queries.ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def above(rows, q):
    """(doc_id, source, words, threshold) above the nearest rank of their source."""
    by = defaultdict(list)
    for _, source, words in rows:
        by[source].append(words)
    limit = {s: sorted(w)[max(1, math.ceil(q * len(w))) - 1] for s, w in by.items()}
    return sorted(((d, s, w, limit[s]) for d, s, w in rows if w > limit[s]), key=str)


def documents(spark, data, k):
    """The test table in three parts by doc_id, with a null and an odd source."""
    df = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    source = F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") % 50 == 1, "a/b=c").when(F.col("doc_id") % 50 == 2, "").otherwise(F.col("source"))
    return df.withColumn("source", source).withColumn("text", F.when(F.col("doc_id") % 97 > 0, F.col("text"))).where(F.col("doc_id") % 3 == k)


def samples(df):
    return [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in df.collect()]


def test_growing_texts(spark, data, tmp_path, caplog):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda **how: sorted(((r["doc_id"], r["source"], r["words"], r["threshold"]) for r in text_extremes.run(spark, source, output, checkpoint, quantile=0.9, **how).collect()), key=str)
    known = []
    caplog.set_level(logging.INFO, "jobs")
    for k in range(3):
        part = documents(spark, data, k)
        part.repartition(3).write.mode("append").parquet(source)
        known += samples(part)
        caplog.clear()
        assert run(files_per_batch=2) == above(known, 0.9)
        assert f"{part.count()} new rows" in caplog.text and f"of {len(known)} samples" in caplog.text
        caplog.clear()
        assert run(files_per_batch=2) == above(known, 0.9)  # nothing new: the same
        assert " 0 new rows" in caplog.text
    shelves = {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert {"SHELF=none", "SHELF=s-", "SHELF=s-a_b=c".replace("=c", "_c")} <= shelves


def test_a_batch_that_is_run_again(spark, data, tmp_path):
    """The sink has written, but the stream did not note it: the batch replaces itself."""
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k in (0, 1):
        documents(spark, data, k).coalesce(1).write.mode("append").parquet(source)
        text_extremes.run(spark, source, output, checkpoint)
    want = spark.read.parquet(output).collect()
    commits = sorted((tmp_path / "checkpoint" / "stream" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "checkpoint" / "stream" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    again = text_extremes.run(spark, source, output, checkpoint).collect()
    assert sorted(map(str, again)) == sorted(map(str, want))
    assert text_extremes.samples(spark, checkpoint).count() == documents(spark, data, 0).count() + documents(spark, data, 1).count()


def test_no_texts(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(source)
    assert text_extremes.run(spark, source, output, checkpoint).collect() == []


def small(spark, path, orders, customers=((1, 1), (2, 2), (3, 99)), nations=((1, "ONE", 1), (2, "TWO", 9))):
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.mode("overwrite").parquet(f"{path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.mode("overwrite").parquet(f"{path}/customer.parquet")
    spark.createDataFrame(nations, "n_nationkey int, n_name string, n_regionkey int").write.mode("overwrite").parquet(f"{path}/nation.parquet")
    spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string").write.mode("overwrite").parquet(f"{path}/region.parquet")


def at(year):
    import datetime

    return datetime.datetime(year, 6, 1)


def test_annual_extremes(spark, tmp_path, caplog):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    orders = [(i, 1 + i % 4, at(2000 + i % 2), float(i)) for i in range(40)] + [(90, 1, at(1990), 9e9), (91, 1, at(2001), None)]
    small(spark, source, orders)
    caplog.set_level(logging.INFO, "jobs")
    run = lambda: {(r["REGION"], r["DOMAIN"], r["YEAR"]): r for r in nation_extremes.run(spark, source, output, 0.5, 2000, 2002).collect()}
    got = run()
    assert set(got) == {(r, d, y) for r, d in (("R", "ONE"), ("UNKNOWN", "TWO"), ("UNKNOWN", "UNKNOWN")) for y in (2000, 2001, 2002)}
    one = got["R", "ONE", 2000]
    assert (one["N_EVENTS"], one["N_EXTREME"], one["THRESHOLD"], one["MEAN_EXTREME"]) == (10, 5, 16.0, 28.0)
    assert (got["R", "ONE", 2001]["N_EVENTS"], got["R", "ONE", 2001]["N_EXTREME"]) == (1, 0)  # an event without a value
    assert got["UNKNOWN", "UNKNOWN", 2000]["N_EVENTS"] == 10 and got["UNKNOWN", "UNKNOWN", 2001]["N_EVENTS"] == 10
    assert got["R", "ONE", 2002]["SHARE"] is None
    assert "42 rows" in caplog.text and "9 rows in 6 partitions" in caplog.text
    assert run() == got


def test_bad_keys_write_nothing(spark, tmp_path):
    source, output = str(tmp_path / "in"), tmp_path / "out"
    small(spark, source, [(1, 1, at(2000), 1.0), (1, 1, at(2000), 2.0), (2, 1, None, 1.0)])
    with pytest.raises(ValueError, match="null time.*repeated o_orderkey"):
        nation_extremes.run(spark, source, str(output))
    assert not output.exists()
    assert nation_extremes.run(spark, source, str(output), strict=False).count() == 7


def test_command_lines(data, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"quantile": 0.8}))
    for job, more in (("nation_extremes", []), ("text_extremes", ["--checkpoint", str(tmp_path / "cp"), "--config", str(config)])):
        source = f"{data}/sf0.001" + ("/documents.parquet*" if more else "")
        args = [sys.executable, "-m", f"jobs.{job}", "--source", source, "--output", str(tmp_path / job), "--master", "local[2]", *more]
        done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0, done.stderr[-3000:]
        assert f"wrote {tmp_path / job}" in done.stderr
        assert list((tmp_path / job).rglob("*.parquet"))
