import dataclasses
import hashlib
import json
import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluvia.operators import audit, events, features, fields, report, thresholds, tracks
from pluvia.sources import files

CELLS = "SID string, TIME timestamp, BASIN string, TC_LAT float, ROW int, PRECIP_3H_MM float, IS_INTERPOLATED_TIMESTEP boolean"
T0 = datetime(2000, 1, 1)


def cells(spark, rows):
    return spark.createDataFrame([("S", T0, "NA", 10.0, *r) for r in rows], CELLS)


def test_events_are_strict_exceedances(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 11.0), (3, 13.0), (4, float("nan"))], "ROW int, POT99_MM_3H float")
    x = events.extreme_cells(cells(spark, [(1, 10.0, False), (2, 12.0, False), (3, 14.0, False), (4, 99.0, False), (5, 99.0, False)]), events.checked_thresholds(t))
    e = events.build_events(x).collect()
    assert len(e) == 1 and (e[0]["N_EXTREME_CELLS"], e[0]["EVENT_INTENSITY_MM_3H"], e[0]["HEMISPHERE"], e[0]["BASIN"]) == (2, 13.0, "NH", "NA")
    for bad in ([(1, 1.0), (1, 2.0)], [(6_480_000, 1.0)]):
        with pytest.raises(Exception, match="duplicate or invalid"):
            events.checked_thresholds(spark.createDataFrame(bad, "ROW int, POT99_MM_3H float")).collect()


def test_batches_add_up(spark):
    a, b = cells(spark, [(1, 10.0, False)]), cells(spark, [(2, 20.0, True), (3, 30.0, True)])
    m = events.merged_events(events.partial_events(a), events.partial_events(b)).collect()[0]
    w = events.build_events(a.unionByName(b)).collect()[0]
    assert (m["N_EXTREME_CELLS"], m["EVENT_INTENSITY_MM_3H"], m["IS_INTERPOLATED_TIMESTEP"]) == (3, 20.0, True) == (w["N_EXTREME_CELLS"], w["EVENT_INTENSITY_MM_3H"], w["IS_INTERPOLATED_TIMESTEP"])


def test_bins_on_edges(spark):
    e = thresholds.edges()
    v = np.unique(np.concatenate([e[1:], np.nextafter(e[1:], np.float32(0)), np.nextafter(e, np.float32(200)), np.random.default_rng(1).uniform(0.31, 130, 4000).astype(np.float32)]))
    v = v[v > np.float32(0.3)]
    want = np.minimum(np.searchsorted(e[1:], v, "left"), thresholds.BINS)
    df = spark.createDataFrame([(float(x), int(w)) for x, w in zip(v, want, strict=True)], "v float, w int")
    assert df.where(thresholds.bin_of(F.col("v")) != F.col("w")).count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    data = {r: (rng.gamma(0.5, 20 if r else 200, 300 + r)).astype(np.float32) for r in range(6)}
    df = spark.createDataFrame([(r, float(x)) for r, v in data.items() for x in v] + [(0, float("nan")), (1, 0.1)], "ROW int, p float")
    got = {r["ROW"]: r for r in thresholds.refined(df, "p").collect()}
    assert {r["ROW"]: r["POT99"] for r in thresholds.exact(df, "p").collect()}.keys() == data.keys()
    for r, v in data.items():
        wet = np.sort(v[v > np.float32(0.3)])
        exact = wet[int(np.ceil(0.99 * len(wet))) - 1]
        assert got[r]["N_WET"] == len(wet)
        if exact > 120:
            assert got[r]["THRESHOLD_METHOD"] == "exact" and got[r]["POT99"] == exact
        else:
            assert abs(got[r]["POT99"] - exact) <= (thresholds.HIGH - thresholds.LOW) / thresholds.BINS
    assert {x["THRESHOLD_METHOD"] for x in got.values()} == {"exact", "histogram"}


def raw(spark, rows):
    return spark.createDataFrame([(s, "2000", b, "N", t, str(la), str(lo), k, "TS", w, "", "") for s, t, la, lo, k, w, b in rows], ", ".join(f"{c} string" for c in files.TRACK_COLUMNS))


def test_tracks(spark):
    rows = [("A", "2000-01-01 00:00:00", 10, 359, "main", "30", "NA"), ("A", "2000-01-01 03:00:00", 50, 200, "main", "99", "NA"), ("A", "2000-01-01 06:00:00", 12, 1, "main", " ", "NA"), ("A", "2000-01-01 12:00:00", 14, 3, "main", "60", "NA")]
    rows += [("B", "2000-05-01 03:00:00", -5, -10, "main", "", "SI"), ("C", "2000-05-01 00:00:00", 1, 1, "spur-other", "", "WP"), ("D", "1999-05-01 00:00:00", 1, 1, "main", "", "WP"), ("E", "bad", 1, 1, "main", "", "WP"), ("F", "2000-05-01 00:00:00", "", 1, "main", "", "WP")]
    rows += [("G", "1999-12-31 18:00:00", 0, 0, "main", "", ""), ("G", "2000-01-01 00:00:00", 6, 6, "main", "", "EP")]
    got = {(r["SID"], r["TIME"].hour): r for r in tracks.prepare(raw(spark, rows), 2000, 2000).collect()}
    assert sorted(got) == [("A", 0), ("A", 3), ("A", 6), ("A", 9), ("A", 12), ("B", 3), ("G", 0)]
    a = got["A", 3]
    assert (a["LAT"], a["LON"], a["BASIN"], a["USA_WIND"], a["INTENSITY_CAT"]) == (11.0, pytest.approx(0.0, abs=1e-9), "NA", 37.5, "TS")
    assert a["SEASON"] is None and got["A", 6]["SEASON"] == "2000" and got["A", 6]["USA_WIND"] == 45.0
    assert (got["B", 3]["LON"], got["B", 3]["USA_WIND"], got["B", 3]["INTENSITY_CAT"]) == (350.0, None, None)
    assert got["G", 0]["LAT"] == 6.0 and got["A", 0]["YEAR"] == 2000


def plain_labels(points):
    left, out = set(points), {}
    for p in sorted(points):
        if p in left:
            todo = [p]
            left.discard(p)
            while todo:
                i, j = todo.pop()
                out[i, j] = p
                for q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=90))
def test_connected_components(points):
    pts = list(points)
    i, j = (np.array(x) for x in zip(*pts, strict=True))
    label = features.connected(i, j)
    assert {p: pts[k] for p, k in zip(pts, label.tolist(), strict=True)} == plain_labels(points)


def storm(spark, wet, lat=0.0, lon=0.1, sid="S"):
    t = spark.createDataFrame([(sid, T0, "NA", lat, lon)], "SID string, TIME timestamp, BASIN string, LAT double, LON double")
    f = spark.createDataFrame([(T0, int(round((89.95 - a) / 0.1)) * 3600 + int(round(((b % 360) - 0.05) / 0.1)), p, False) for a, b, p in wet], "TIME timestamp, ROW int, PRECIP_3H_MM float, IS_INTERPOLATED boolean")
    return t, f


def test_attribution(spark):
    wet = [(0.05, 0.05, 1.0), (-0.05, 0.15, 1.0), (0.05, 359.95, 1.0), (0.05, 3.05, 0.3), (0.05, 3.15, float("nan")), (0.05, 3.25, -2.0), (6.05, 0.05, 5.0), (9.95, 0.05, 5.0)]
    t, f = storm(spark, wet)
    a = features.attributed(t, f).collect()
    assert sorted(round(r["GRID_LON"], 2) for r in a) == [0.05, 0.15, 359.95] and all(r["PRECIP_MMHR"] == pytest.approx(1 / 3) for r in a)
    x = {r["ROW"]: r["FEATURE"] for r in features.labelled(features.wet_cells(features.candidates(t, f))).collect()}
    assert len(set(x.values())) == 3  # a diagonal does not connect; the seam does
    t2, _ = storm(spark, [], sid="S2")
    assert features.attributed(t.unionByName(t2), f).count() == 6
    t3 = t.withColumn("LAT", F.lit(None).cast("double"))
    assert features.attributed(t3, f).count() == 0


def test_window_clips_the_circle_in_the_north(spark):
    t, f = storm(spark, [(60.05, 17.95, 5.0), (60.05, 18.05, 5.0), (63.05, 19.05, 5.0)], lat=60.0, lon=0.0)
    got = {round(r["GRID_LON"], 2): (r["DIST_KM"], r["DLON"]) for r in features.candidates(t, f).collect()}
    assert 17.95 in got and got[17.95][0] <= 1000
    assert 19.05 not in got


def test_tiles_lose_no_cell_and_spare_pairs(spark):
    """Storms at the seam, near the poles and on the edges of tiles, against every cell of a coarse grid."""
    cells = [i * 3600 + j for i in range(0, 1800, 20) for j in range(0, 3600, 30)]
    t0 = T0
    f = spark.createDataFrame([(t0, r, 1.0, False) for r in cells], "TIME timestamp, ROW int, PRECIP_3H_MM float, IS_INTERPOLATED boolean")
    storms = [(f"S{k}", t0, float(lat), float(lon)) for k, (lat, lon) in enumerate([(0, 0), (10, 359.95), (-45, 15), (45, 14.95), (80, 180), (89, 3), (-88, 270), (20, -179.9), (-5, 5), (60, 0.05)])]
    t = spark.createDataFrame(storms, "SID string, TIME timestamp, LAT double, LON double")
    got = {(r["SID"], r["ROW"]) for r in features.candidates(t, f).select("SID", "ROW").collect()}
    want = set()
    for sid, _, lat, lon in storms:
        wide = min(1000 / (111 * max(math.cos(math.radians(lat)), 0.08)), 170)
        for r in cells:
            la, lo = 89.95 - r // 3600 * 0.1, r % 3600 * 0.1 + 0.05
            if abs(la - lat) <= 1000 / 111 and abs((lo - lon % 360 + 180) % 360 - 180) <= wide:
                want.add((sid, r))
    assert got == want
    near = t.where("abs(LAT) <= 20")
    rings = sum(abs(math.floor((89.95 - r // 3600 * 0.1) / 5) - k) == 0 for _, _, lat, _ in storms if abs(lat) <= 20 for k in range(math.floor((lat - 1000 / 111) / 5), math.floor((lat + 1000 / 111) / 5) + 1) for r in cells)
    assert features.met(near, f).count() * 5 < rings
    assert features.met(t, f).groupBy("SID", "ROW").count().where("count > 1").isEmpty()


def test_cells_are_sound(spark):
    t, f = storm(spark, [(0.05, 0.05, 1.0), (-0.05, 0.05, 2.0), (0.05, 359.95, 1.5)])
    a = features.attributed(t, f)
    assert audit.passed(audit.cells(a))
    bad = a.withColumn("PRECIP_MMHR", F.col("PRECIP_MMHR") * 2)
    assert [r["check"] for r in audit.cells(bad).where("failures > 0").collect()] == ["rate"]
    b = audit.boundary(a).collect()[0]
    assert b["crosses_zero"] and b["bad_rows"] == 0 and b["max_km"] < 20


def test_fields(spark):
    assert fields.calendar(spark, 2000, 2000).count() == 366 * 8
    listing = spark.createDataFrame([("2000001.00.nc", "a"), ("2000001.03.nc", "b"), ("x.nc", "c")], "NAME string, PATH string")
    over = spark.createDataFrame([("2000001.03.nc", "o")], "NAME string, PATH string")
    assert sorted(tuple(r) for r in fields.index(listing, over).collect()) == [("2000001.00.nc", "a"), ("2000001.03.nc", "o"), ("x.nc", "c")]
    with pytest.raises(Exception, match="no file for"):
        fields.complete_index(fields.calendar(spark, 2000, 2000).limit(3), listing, over).collect()
    a, b = (spark.createDataFrame(x, "ROW int, PRECIP_3H_MM float") for x in ([(1, 0.2), (2, None)], [(1, 0.6), (2, 1.0)]))
    assert [(r[0], r[1] and round(r[1], 6)) for r in fields.blended(a, b, 0.5).orderBy("ROW").collect()] == [(1, 0.4), (2, None)]
    with pytest.raises(Exception, match="different cells"):
        fields.blended(a, b.where("ROW = 1"), 0.5).collect()
    assert fields.bracket_weight("2020-12-31 00:00", "2020-12-31 03:00", "2021-01-01 00:00") == 1 / 8
    with pytest.raises(ValueError):
        fields.bracket_weight("2020-12-31 03:00", "2020-12-31 03:00", "2021-01-01 00:00")


class FakeVariable(np.ndarray):
    pass


def test_field_files():
    class Data:
        is_interpolated = 1

    def var(x, **attrs):
        v = np.asarray(x, float).view(FakeVariable)
        for k, a in attrs.items():
            setattr(v, k, a)
        return v

    d = Data()
    d.variables = {"lat": var([0.05, -0.05]), "lon": var([-0.05, 0.05, 0.15]), "precipitation": var(np.arange(6).reshape(2, 3), units="mm/3h")}
    out = [r for b in files.field_batches(d, "dir/2000060.03.nc", "precipitation") for r in b.to_pylist()]
    assert out[0]["TIME"].strftime("%Y-%m-%d %H") == "2000-02-29 03" and out[0]["IS_INTERPOLATED"]
    assert [(r["ROW"], r["PRECIP_3H_MM"]) for r in out[:3]] == [(899 * 3600, 1.0), (899 * 3600 + 1, 2.0), (899 * 3600 + 3599, 0.0)]
    d.variables["precipitation"] = var(np.zeros((2, 3)), units="mm/h")
    with pytest.raises(ValueError):
        list(files.field_batches(d, "2000060.03.nc", "precipitation"))


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("SID,SEASON,BASIN,NAME,ISO_TIME,LAT,LON,TRACK_TYPE,USA_STATUS,USA_WIND,USA_PRES,IFLAG,X\n ,Year, , , ,degrees_north,degrees_east, , ,kts,mb, ,\nA,2000,NA,N,2000-01-01 00:00:00,1,2,main,,,,O,1\n")
    r = files.raw_tracks(spark, str(tmp_path / "t.csv")).collect()
    assert len(r) == 1 and r[0]["BASIN"] == "NA" and r[0]["USA_WIND"] == ""
    (tmp_path / "c.csv").write_text("BASIN,x\nNA,\nWP,0.1\n")
    assert [tuple(x) for x in files.csv_table(spark, str(tmp_path / "c.csv"), "BASIN string, x double").collect()] == [("NA", None), ("WP", 0.1)]
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.json_table(spark, str(tmp_path / "j.json")).count() == 2
    out = str(tmp_path / "annual")
    df = spark.createDataFrame([(2000, "a"), (2001, "b")], "YEAR int, v string")
    files.write_annual(df, out)
    with pytest.raises(FileExistsError):
        files.write_annual(df, out)
    files.write_annual(df.where("YEAR = 2001").withColumn("v", F.lit("new")), out, overwrite=True)
    assert {(x["YEAR"], x["v"]) for x in files.annual(spark, out, 2000, 2001).collect()} == {(2000, "a"), (2001, "new")}
    with pytest.raises(FileNotFoundError):
        files.annual(spark, out, 2000, 2002)
    assert sum(x["rows"] for x in files.parquet_metadata(spark, out).collect()) == 2
    foot = files.parquet_footers(spark, out).collect()
    assert sum(f["rows"] for f in foot) == 2 and all(f["row_groups"] == 1 and f["columns"] == ["v"] for f in foot)
    x = spark.createDataFrame([(0.1 + 0.2, "NA")], "x double, b string")
    files.write_csv(x, str(tmp_path / "out"))
    assert files.csv_table(spark, str(tmp_path / "out"), "x double, b string").first()[0] == 0.1 + 0.2
    names = {r["NAME"]: r for r in files.listing(spark, str(tmp_path), "*.json").collect()}
    assert names["j.json"]["SIZE"] == 21
    import hashlib

    assert files.digests(spark, str(tmp_path), "j.json").first()["SHA256"] == hashlib.sha256((tmp_path / "j.json").read_bytes()).hexdigest()


def test_reports(spark):
    old = spark.createDataFrame([(2000, 1), (2001, 2)], "YEAR int, n int")
    new = spark.createDataFrame([(2001, 9), (2002, 3)], "YEAR int, n int")
    assert sorted(map(tuple, report.upserted(old, new).collect())) == [(2000, 1), (2001, 9), (2002, 3)]
    assert report.markdown(old, ["YEAR"]) == "| YEAR | n |\n| --- | --- |\n| 2000 | 1 |\n| 2001 | 2 |\n"
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, value double")
    assert [r["k"] for r in audit.release(a, a.withColumn("value", F.col("value") + F.when(F.col("k") == "y", 1e-6).otherwise(0)), ["k"]).collect()] == ["y"]
    axis = spark.createDataFrame([(i, -float(i)) for i in range(5)] + [(5, 0.0)], "i int, v double")
    assert audit.monotonic(axis, "i", "v").first()["failures"] == 1


def test_workflow_and_streaming(spark, tmp_path):
    from pluvia.plans.workflow import Settings, run
    from pluvia.streaming import incremental

    rng = np.random.default_rng(5)
    head = ",".join(files.TRACK_COLUMNS)
    pos, rows = [], []
    for y in (2000, 2001, 2002):
        for k, (lat, lon, basin) in enumerate([(5, 150, "WP"), (20, 150, "WP"), (30, 300, "NA"), (40, 300, "NA"), (-5, 60, "SI"), (-12, 60, "SI"), (-17, 60, "SI"), (-25, 60, "SI")]):
            for h in (0, 6):
                pos.append(f"S{y}{k},{y},{basin},N,{y}-02-0{k + 1} 0{h}:00:00,{lat + 0.05 + h / 60},{lon + 0.05},main,TS,{40 + k},990,")
            for h in (0, 3, 6):
                t = datetime(y, 2, k + 1, h)
                for i in range(4):
                    for j in range(4):
                        row = int(round((89.95 - (lat + 0.05)) / 0.1) - i) * 3600 + int(round(lon / 0.1)) + j
                        rows.append((t, row, float(rng.gamma(2, 10)), False))
    (tmp_path / "tracks.csv").write_text("\n".join([head, ",".join([" "] * 12), *pos]) + "\n")
    f = spark.createDataFrame(rows, "TIME timestamp, ROW int, PRECIP_3H_MM float, IS_INTERPOLATED boolean")
    f.write.parquet(str(tmp_path / "fields"))
    s = Settings(work=str(tmp_path / "w"), tracks_csv=str(tmp_path / "tracks.csv"), fields=str(tmp_path / "fields"), first=2000, last=2002, repetitions=5, block_years=2, partial=True, land=str(tmp_path / "land"))
    spark.range(0, 6_480_000, 2).select(F.col("id").cast("int").alias("ROW")).write.parquet(s.land)
    with pytest.raises(FileNotFoundError, match="2000001.00.nc"):
        run(spark, dataclasses.replace(s, partial=False, work=str(tmp_path / "other")), "histograms")
    for stage in ("tracks", "cells", "histograms", "thresholds"):
        run(spark, s, stage)
    t = spark.read.parquet(f"{s.work}/thresholds")
    assert audit.passed(audit.thresholds(t, exact_cells=t.where("IS_EXACT_TAIL_REFINEMENT").count())) and t.count() == 8 * 16
    assert {r[0] for r in t.select("WET_SAMPLE_RULE").distinct().collect()} == {">0.3 mm/3h"}
    assert {r["YEAR"] for r in spark.read.parquet(f"{s.work}/merged_years").collect()} == {2000, 2001, 2002}
    t.withColumn("POT99_MM_3H", F.col("POT99_MM_3H") * F.lit(0.5).cast("float")).write.parquet(f"{s.work}/lower")
    (tmp_path / "w" / "thresholds").rename(tmp_path / "w" / "first")
    (tmp_path / "w" / "lower").rename(tmp_path / "w" / "thresholds")
    run(spark, s, "events")
    run(spark, s, "analysis")
    ev, x = (spark.read.parquet(f"{s.work}/{n}") for n in ("events", "extreme_cells"))
    assert audit.reaggregated(ev, x).count() == 0 and ev.count() == 72 and audit.passed(audit.margins(x))
    assert spark.read.parquet(f"{s.work}/analysis/component_trends").count() == 8
    with pytest.raises(Exception, match="(?i)exist"):
        run(spark, s, "tracks")
    run(spark, s, "figures")
    run(spark, s, "tables")
    saved = lambda n: spark.read.parquet(f"{s.work}/{n}")
    assert saved("figures/samples").count() == 72 and saved("figures/annual_series").count() == 9 and saved("figures/latitude_series").count() == 12
    assert saved("figures/surface_bands").count() == 2 * 2 * 3 * 4 and saved("tables/S3A_surfaces").count() == 4
    assert saved("tables/S1C_baselines").agg(F.sum("n_events")).first()[0] == 72 and saved("tables/S1").count() == 2
    assert spark.read.csv(f"{s.work}/tables/S2_csv", header=True).count() == saved("tables/S2").count() > 0
    assert "Northern Hemisphere" in "".join(r.value for r in spark.read.text(f"{s.work}/tables/S1_markdown").collect())

    from pluvia.plans import audits

    told = lambda name, **more: {r["check"]: r["failures"] for r in audits.report(spark, dataclasses.replace(s, **more), name).collect()}
    assert set(told("cells").values()) == {0} and set(told("events").values()) == {0}
    assert told("cells", last=2004)["years without cells"] == 2
    assert told("thresholds")["duplicate keys"] == 0
    found = told("inputs")
    assert found.pop("missing files") == 366 * 8 + 2 * 365 * 8 - 3 * 24 and set(found.values()) == {0}
    named = lambda df, *keys: [{**{k: r[k] for k in keys}, "trend_per_decade": r["slope"], "p_value": r["p_value"]} for r in df.select(*keys, "slope", "p_value").distinct().collect()]
    maps = saved("figures/spatial_trends")
    source = next((tmp_path / "w" / "events" / "YEAR=2000").glob("*.parquet"))
    expected = {
        "global_and_hemisphere_trends": named(saved("figures/annual_series"), "domain"), "latitude_trends": named(saved("figures/latitude_series"), "record_type", "domain"), "events": 72,
        "valid_map_cells": maps.count(), "significant_map_cells": maps.where("p_value < 0.05").count(), "sources": [{"path": f"YEAR=2000/{source.name}", "sha256": hashlib.sha256(source.read_bytes()).hexdigest()}],
    }
    write = lambda d: (tmp_path / "expected.json").write_text(json.dumps(d))
    write(expected)
    how = {"expected": str(tmp_path / "expected.json"), "intervals": True}
    found = told("release", **how)
    known = {"empty band", "surface trends are not significant"}  # of the published data alone
    assert {k for k, n in found.items() if n} <= known and found["component intervals"] == 0 and found[f"sha256 YEAR=2000/{source.name}"] == 0
    write({**expected, "events": 71, "sources": [{"path": f"YEAR=2000/{source.name}", "sha256": "0" * 64}]})
    assert {k for k, n in told("release", **how).items() if n} - known == {"event count", f"sha256 YEAR=2000/{source.name}"}

    stream = spark.readStream.schema(x.select("SID", "TIME", "BASIN", "TC_LAT", "PRECIP_3H_MM", "IS_INTERPOLATED_TIMESTEP").schema).parquet(f"{s.work}/extreme_cells")
    q = incremental.event_stream(stream).writeStream.format("memory").queryName("ev").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    same = ["SID", "TIME", "N_EXTREME_CELLS"]
    assert spark.table("ev").select(*same).exceptAll(ev.select(*same)).count() == 0 and spark.table("ev").count() == 72

    cells = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(s.fields)
    q = incremental.histogram_stream(cells, f"{tmp_path}/h", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    want = thresholds.histogram(f, "PRECIP_3H_MM")
    assert incremental.stored_histogram(spark, f"{tmp_path}/h").exceptAll(want.select("ROW", "BIN", "N")).count() == 0
    assert incremental.current_thresholds(spark, f"{tmp_path}/h").count() == 128
