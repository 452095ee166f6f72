"""Late and repeated cells, and histograms that go on where they stopped."""

import dataclasses
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pluvia.operators import events
from pluvia.plans.workflow import Settings, run
from pluvia.sources import files
from pluvia.streaming import incremental

SCHEMA = "SID string, TIME timestamp, ROW int, BASIN string, TC_LAT float, PRECIP_3H_MM float, IS_INTERPOLATED_TIMESTEP boolean"


def cell(sid, day, row, value):
    return sid, datetime(2000, 1, day), row, "WP", 10.0, value, False


def values(df):
    return {(r["SID"], r["TIME"].day): (r["EVENT_INTENSITY_MM_3H"], r["N_EXTREME_CELLS"]) for r in df.collect()}


def test_late_and_repeated_cells(spark, tmp_path):
    source, kept, checkpoint = (str(tmp_path / n) for n in ("in", "kept", "checkpoint"))
    batches = [
        [cell("A", 1, 1, 10.0), cell("A", 1, 2, 20.0), cell("B", 9, 1, 5.0)],
        [cell("A", 30, 1, 7.0)],
        [cell("A", 1, 3, 60.0), cell("C", 2, 1, 1.0)],  # weeks late
        [cell("A", 1, 1, 10.0), cell("B", 9, 1, 5.0), cell("B", 9, 1, 5.0)],  # files that come again
        [cell("B", 9, 1, 8.0)],  # a value put right
    ]
    told = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        incremental.keep_extreme(stream, kept, checkpoint, availableNow=True).awaitTermination()
        told.append({(r["SID"], r["TIME"].day): (r["N_EXTREME_CELLS"], r["NEW"]) for r in incremental.revised(spark, kept, k).collect()})
    assert told == [{("A", 1): (2, True), ("B", 9): (1, True)}, {("A", 30): (1, True)}, {("A", 1): (3, False), ("C", 2): (1, True)}, {("A", 1): (3, False), ("B", 9): (1, False)}, {("B", 9): (1, False)}]
    want = {("A", 1): (30.0, 3), ("A", 30): (7.0, 1), ("B", 9): (8.0, 1), ("C", 2): (1.0, 1)}
    assert values(incremental.events_so_far(spark, kept)) == want
    whole = [cell("A", 1, 1, 10.0), cell("A", 1, 2, 20.0), cell("A", 1, 3, 60.0), cell("A", 30, 1, 7.0), cell("B", 9, 1, 8.0), cell("C", 2, 1, 1.0)]
    assert values(events.build_events(spark.createDataFrame(whole, SCHEMA))) == want
    commit = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.unlink()  # the last batch was written, but not noted
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    incremental.keep_extreme(spark.readStream.schema(SCHEMA).parquet(source), kept, checkpoint, availableNow=True).awaitTermination()
    assert values(incremental.events_so_far(spark, kept)) == want


def test_histograms_go_on(spark, tmp_path):
    rows = [(datetime(y, 1, 1, 3 * h), r, float(y - 1999 + r)) for y in range(2000, 2004) for h in range(3) for r in range(3)]
    spark.createDataFrame(rows, "TIME timestamp, ROW int, PRECIP_3H_MM float").withColumn("IS_INTERPOLATED", F.lit(False)).write.parquet(str(tmp_path / "fields"))
    s = Settings(work=str(tmp_path / "w"), fields=str(tmp_path / "fields"), first=2000, last=2001, partial=True, resume=True)
    path = f"{s.work}/histograms"
    assert files.years(spark, path) == []
    run(spark, s, "histograms")
    marks = {p: p.stat().st_mtime_ns for p in (tmp_path / "w" / "histograms").rglob("*.parquet")}
    run(spark, dataclasses.replace(s, last=2003), "histograms")
    assert files.years(spark, path) == [2000, 2001, 2002, 2003]
    assert all(p.stat().st_mtime_ns == t for p, t in marks.items())  # not made again
    whole = Settings(work=str(tmp_path / "v"), fields=s.fields, first=2000, last=2003, partial=True)
    run(spark, whole, "histograms")
    a, b = (spark.read.parquet(f"{w}/histograms").select("YEAR", "ROW", "BIN", "N") for w in (s.work, whole.work))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    run(spark, dataclasses.replace(s, last=2003), "histograms")  # nothing left to do
    assert spark.read.parquet(path).count() == b.count()
    gap = dataclasses.replace(s, work=str(tmp_path / "u"), first=2002, last=2003)
    run(spark, gap, "histograms")
    with pytest.raises(ValueError, match="not the first years"):
        run(spark, dataclasses.replace(gap, first=2000), "histograms")


def test_an_archive_with_gaps_stops_before_anything_is_written(spark, tmp_path):
    spark.createDataFrame([(datetime(2000, 1, 1), 1, 1.0, False)], "TIME timestamp, ROW int, PRECIP_3H_MM float, IS_INTERPOLATED boolean").write.parquet(str(tmp_path / "fields"))
    s = Settings(work=str(tmp_path / "w"), tracks_csv=str(tmp_path / "none.csv"), fields=str(tmp_path / "fields"), first=2000, last=2000)
    for stage in ("all", "histograms"):
        with pytest.raises(FileNotFoundError, match="2000001.03.nc"):
            run(spark, s, stage)
    assert not (tmp_path / "w").exists()


def test_a_track_archive_without_its_columns(spark, tmp_path):
    (tmp_path / "tracks.csv").write_text("SID,SEASON,BASIN,NAME,ISO_TIME,LAT\n , , , , ,\nS,2000,NA,N,2000-01-01 00:00:00,1\n")
    with pytest.raises(ValueError, match="LON.*TRACK_TYPE"):
        run(spark, Settings(work=str(tmp_path / "w"), tracks_csv=str(tmp_path / "tracks.csv"), first=2000, last=2000), "tracks")
