"""The NetCDF source with a stand-in for the netCDF4 library that notes what is read of its files."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import audit
from pluvia.sources import files

LIBRARY = '''
import json
import numpy as np

class Variable:
    def __init__(self, name, values, units, log):
        self.name, self.values, self.log, self.shape = name, np.array(values, float), log, np.array(values).shape
        if units:
            self.units = units
    def __getitem__(self, key):
        part = self.values[key]
        with open(self.log, "a") as f:
            f.write(f"{self.name} {part.size}\\\\n")
        return np.ma.masked_equal(part, -9999.0)

class Dataset:
    def __init__(self, path):
        with open(path) as f:
            d = json.load(f)
        if d.get("flag") is not None:
            self.is_interpolated = d["flag"]
        self.variables = {k: Variable(k, v, d["units"] if k == "precipitation" else None, path + ".log") for k, v in d["variables"].items()}
    def close(self):
        pass
'''.replace("\\\\n", "\\n")
LAT, LON = [0.15, 0.05, -0.05, -0.15], [-0.15, -0.05, 0.05, 0.15, 0.25]


def write(folder, name, lat=LAT, lon=LON, flag=None, units="mm/3h", start=0.0, turned=False, lead=False):
    x = np.arange(len(lat) * len(lon), dtype=float).reshape(len(lat), len(lon)) + start
    x[0, 0] = -9999.0
    x = x.T if turned else x
    x = x[None] if lead else x
    (folder / name).write_text(json.dumps({"flag": flag, "units": units, "variables": {"lat": list(lat), "lon": list(lon), "precipitation": x.tolist()}}))


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lib") / "netCDF4.py"
    path.write_text(LIBRARY)
    spark.sparkContext.addPyFile(str(path))
    spark.dataSource.register(files.FieldSource)


def read(spark, folder, **options):
    paths = "\n".join(f"file:{p}" for p in sorted(folder.glob("*.nc")))
    return spark.read.format("pluvia_field").options(paths=paths, grid="any", **options).load()


def noted(folder):
    """Values of fields read, by file; the notes are cleared."""
    out = {}
    for p in folder.glob("*.log"):
        out[p.name[:-4]] = sum(int(n) for k, n in (line.split() for line in p.read_text().splitlines()) if k == "precipitation")
        p.unlink()
    return out


def test_what_is_read(spark, library, tmp_path):
    for h in range(0, 24, 3):
        write(tmp_path, f"2000060.{h:02d}.nc", flag="true" if h == 3 else None if h else "False", start=100.0 * h, turned=h == 6, lead=h == 9)
    df = read(spark, tmp_path, filesPerPartition=3)
    rows = {(r["TIME"].hour, r["ROW"]): (r["PRECIP_3H_MM"], r["IS_INTERPOLATED"]) for r in df.collect()}
    assert len(rows) == 8 * 20 and df.rdd.getNumPartitions() == 3
    north, west = 898 * 3600, 3598
    assert rows[3, north] == (302.0, True) and rows[0, north] == (2.0, False)
    assert rows[0, north + west] == (None, False) and rows[0, north + west + 1] == (1.0, False)
    assert rows[6, north + 3600 + 2] == (609.0, False) and rows[9, north + 3 * 3600 + 1] == (918.0, False)
    noted(tmp_path)
    one = df.where((F.col("TIME") >= "2000-02-29 06:00:00") & (F.col("TIME") < "2000-02-29 12:00:00"))
    assert {r["TIME"].hour for r in one.collect()} == {6, 9}
    assert set(noted(tmp_path)) <= {"2000060.06.nc", "2000060.09.nc", "2000060.12.nc"}
    at = df.where((F.col("TIME") == datetime(2000, 2, 29, 6)) & F.col("ROW").between(north + 3600, north + 3600 + 1))
    assert sorted(r["ROW"] for r in at.collect()) == [north + 3600, north + 3600 + 1]
    assert noted(tmp_path) == {"2000060.06.nc": 5}  # one latitude
    some = df.where(F.col("ROW").isin(north + 1, north + 3 * 3600) & F.col("TIME").isin(datetime(2000, 2, 29, 0), datetime(2000, 2, 29, 21)))
    assert some.count() == 4
    assert noted(tmp_path) == {"2000060.00.nc": 10, "2000060.21.nc": 10}
    assert df.where(F.col("TIME") > "2001-01-01").count() == 0 and noted(tmp_path) == {}


def test_errors(spark, library, tmp_path):
    write(tmp_path, "2000001.00.nc", flag="maybe")
    with pytest.raises(Exception, match="is no flag"):
        read(spark, tmp_path).collect()
    write(tmp_path, "2000001.00.nc", units="mm/h")
    with pytest.raises(Exception, match="(?i)unit"):
        read(spark, tmp_path).collect()
    write(tmp_path, "2000001.00.nc")
    with pytest.raises(Exception, match="lat of .* has 4 values"):
        spark.read.format("pluvia_field").option("path", f"file:{tmp_path}/2000001.00.nc").load().collect()


def test_headers(spark, library, tmp_path):
    lat, lon = np.round(89.95 - np.arange(1800) * 0.1, 2).tolist(), np.round(-179.95 + np.arange(3600) * 0.1, 2).tolist()
    full = dict.fromkeys(("lat", "lon"))
    full["lat"], full["lon"] = lat, lon

    def header(name, flag=None, units="mm/3h", **axes):
        d = {"flag": flag, "units": units, "variables": {**full, **axes, "precipitation": [[0.0]]}}
        (tmp_path / name).write_text(json.dumps(d))

    header("2000001.00.nc")
    header("2000001.03.nc", flag="1", units="mm 3h-1")
    header("2000001.06.nc", units="kg")
    header("2000001.09.nc", lat=lat[::-1])
    header("2000001.12.nc", lon=lon[:-1])
    header("2000001.15.nc", lon=[lon[1], lon[0], *lon[2:]])
    h = files.headers(spark, [f"file:{p}" for p in sorted(tmp_path.glob("*.nc"))])
    assert h.count() == 12 and h.where("IS_INTERPOLATED").select("NAME").distinct().collect()[0][0] == "2000001.03.nc"
    got = {r["check"]: r["failures"] for r in audit.archive_grids(h).collect()}
    assert got == {"lat size": 0, "lat direction": 1, "lat ends": 1, "lon size": 1, "lon direction": 1, "lon ends": 2, "unit": 1}
    assert "precipitation" not in "".join(p.read_text() for p in tmp_path.glob("*.log"))
    assert {r["TIME"].hour for r in files.headers(spark, [f"file:{p}" for p in tmp_path.glob("*.nc")]).where(F.col("TIME") >= "2000-01-01 12:00:00").collect()} == {12, 15}
