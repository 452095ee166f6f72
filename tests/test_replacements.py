"""Replacement of gaps, and kernels that end."""

import dataclasses
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import dist, fields
from pluvia.plans.workflow import Settings, field_table, run

T0 = datetime(2001, 1, 1)


def test_a_year_with_gaps(spark, tmp_path):
    """Made whole by the stage, and taken by the workflow as overrides."""
    gone = {5, 6, 7, 100, 2918}
    steps = spark.range(2920).where(~F.col("id").isin(*gone)).select(F.timestamp_seconds(F.lit(978_307_200) + F.col("id") * 10800).alias("TIME"), "id")
    f = steps.select("TIME", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ROW"), "id")
    f = f.select("TIME", F.col("ROW").cast("int"), F.when(F.col("ROW") < 3, F.col("id") + F.col("ROW") * 1000).cast("float").alias("PRECIP_3H_MM"), F.lit(False).alias("IS_INTERPOLATED"))
    f.write.parquet(str(tmp_path / "fields"))
    s = Settings(work=str(tmp_path / "w"), fields=str(tmp_path / "fields"), first=2001, last=2001)
    run(spark, s, "replace")
    got = {(r["TIME"], r["ROW"]): (r["PRECIP_3H_MM"], r["IS_INTERPOLATED"]) for r in spark.read.parquet(f"{s.work}/replaced/fields").collect()}
    assert got == {(T0 + timedelta(hours=3 * k), row): (None if row == 3 else k + 1000.0 * row, True) for k in gone for row in range(4)}
    told = {r["NAME"]: r for r in spark.read.parquet(f"{s.work}/replaced/provenance").collect()}
    assert len(told) == len(gone)
    one = told["2001001.18.nc"]  # step 6, between 4 and 8
    assert (one["SOURCE_BEFORE"], one["SOURCE_AFTER"], one["WEIGHT_BEFORE"], one["WEIGHT_AFTER"], one["METHOD"]) == ("2001001.12.nc", "2001002.00.nc", 0.5, 0.5, fields.METHOD)
    with pytest.raises(FileNotFoundError):
        field_table(spark, s)
    whole = field_table(spark, dataclasses.replace(s, overrides=f"{s.work}/replaced/fields"))
    assert whole.count() == 2920 * 4 and whole.where("IS_INTERPOLATED").count() == 4 * len(gone)
    with pytest.raises(Exception, match="between the two fields"):
        run(spark, dataclasses.replace(s, last=2002, work=str(tmp_path / "v")), "replace")


def test_kernels_against_all_places(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(3, 2, 300), "b": np.array([1.0, 1.0, 50.0]), None: rng.random(40)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", float("nan")), ("a", None), ("one", 2.0), ("same", 1.0), ("same", 1.0)]
    got = {}
    for r in dist.kernel_density(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", -5.0, 60.0, 80).withColumnRenamed("x", "at").collect():
        got.setdefault(r["k"], {})[round(r["at"], 9)] = r["density"]
    at = np.linspace(-5, 60, 80)
    for k, v in groups.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-(((at[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert [got[k][round(x, 9)] for x in at] == pytest.approx(want.tolist(), abs=1e-12)
    assert set(got["one"].values()) == set(got["same"].values()) == {None}
