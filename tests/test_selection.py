"""Order statistics of large groups, and pair statistics of long series, against all values and all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import dist, selection, slopes, thresholds, trend


def all_pairs(t, y):
    i, j = np.triu_indices(len(t), 1)
    i, j = np.where(t[i] <= t[j], i, j), np.where(t[i] <= t[j], j, i)
    ok = t[i] < t[j]
    i, j = i[ok], j[ok]
    return (y[j] - y[i]) / (t[j] - t[i]), np.sign(y[j] - y[i])


KINDS = {
    "random": lambda rng, n: (np.arange(n), rng.standard_normal(n)),
    "few values": lambda rng, n: (np.arange(n), rng.integers(0, 4, n)),
    "two slopes": lambda rng, n: (np.arange(n), np.where(np.arange(n) < n // 2, 0, np.arange(n))),
    "one line": lambda rng, n: (np.arange(n), 3.7 * np.arange(n) + 1e6),
    "repeated times": lambda rng, n: (rng.integers(0, max(2, n // 2), n), rng.standard_normal(n)),
    "repeated points": lambda rng, n: (rng.integers(0, max(2, n // 3), n), rng.integers(0, 3, n)),
    "steep": lambda rng, n: (np.sort(rng.random(n)), rng.standard_normal(n) ** 9 * 1e6),
}


@pytest.mark.parametrize("kind", KINDS)
def test_pairs(kind):
    rng = np.random.default_rng(5)
    for n in (2, 3, 10, 61, 200, 333):
        for enough in (None, 64, 500):
            t, y = (x.astype(float) for x in KINDS[kind](rng, n))
            s, sign = all_pairs(t, y)
            got = slopes.median_slope(t, y, enough=enough)
            assert got is None if not len(s) else got == pytest.approx(np.median(s), rel=1e-9, abs=1e-9)
            _, c = np.unique(y, return_counts=True)
            assert slopes.signs(t, y) == (sign.sum(), (c * (c - 1.0) * (2 * c + 5)).sum())


def test_inversions_by_number():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        r = rng.permutation(n)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if r[i] > r[j]}
        total, i, j = slopes.inversions(r, np.arange(len(want)))
        assert total == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
        some = np.arange(0, len(want), 3)
        _, i, j = slopes.inversions(r, some)
        assert len(set(zip(i.tolist(), j.tolist(), strict=True)) & want) == len(some)


def test_long_and_short_series_in_one_table(spark):
    rng = np.random.default_rng(2)
    series = {"long": rng.standard_normal(1500), "ties": rng.integers(0, 5, 900).astype(float), "short": rng.standard_normal(40), None: np.arange(300.0), "two": np.arange(2.0), "edge": rng.random(trend.PAIRWISE)}
    rows = [(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)] + [("long", 9000, float("nan")), ("short", 77, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, YEAR int, y double").repartition(3)
    got = {r["k"]: r for r in trend.trends(df, ["k"], "y", per=1.0).collect()}
    assert set(got) == {*series, "none"}
    assert (got["none"]["slope"], got["none"]["n"], got["none"]["p_value"]) == (None, 0, None)
    for k, y in series.items():
        n = len(y)
        s, sign = all_pairs(np.arange(n, dtype=float), y)
        c = np.unique(y, return_counts=True)[1]
        var = (n * (n - 1) * (2 * n + 5) - (c * (c - 1) * (2 * c + 5)).sum()) / 18
        assert got[k]["n"] == n
        if n < 3:
            assert got[k]["slope"] is None and got[k]["p_value"] is None
            continue
        assert got[k]["slope"] == pytest.approx(np.median(s), rel=1e-9, abs=1e-12)
        assert got[k]["p_value"] == pytest.approx(math.erfc(abs(sign.sum() - np.sign(sign.sum())) / math.sqrt(var) / math.sqrt(2)), abs=1e-9)
    line = trend.sen_line(df.where("k = 'long'"), ["k"], "y").where("y IS NOT NULL AND NOT isnan(y)").select("YEAR", "slope", "intercept").collect()
    y = series["long"]
    assert len(line) == 1500
    assert line[0]["intercept"] == pytest.approx(np.median(y - line[0]["slope"] * np.arange(1500)))


LEVELS = (0.0, 0.001, 0.1, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("small", [selection.SMALL, 50])
def test_quantiles_of_any_group(spark, monkeypatch, small):
    """With SMALL low, and a coarser sketch, brackets are narrow and most rows lie between them."""
    monkeypatch.setattr(selection, "SMALL", small)
    if small == 50:
        monkeypatch.setattr(selection, "ACCURACY", 100)
    rng = np.random.default_rng(4)
    groups = {"normal": rng.standard_normal(4000), "ties": rng.integers(0, 3, 3000).astype(float), "one value": np.full(2000, 7.5), "heavy": rng.pareto(0.3, 3000), "one": np.array([3.0]), None: rng.random(1000), "few": np.array([1.0, 2.0, 4.0, 8.0])}
    rows = [(k, float(v)) for k, y in groups.items() for v in y] + [("normal", None), ("few", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r["k"]: r for r in selection.quantiles(df, ["k"], "x", LEVELS).collect()}
    assert set(got) == set(groups)
    for k, y in groups.items():
        assert got[k]["n"] == len(y)
        assert got[k]["q"] == pytest.approx(np.quantile(y, LEVELS).tolist(), rel=1e-12)
    for level in (0.01, 0.5, 0.99, 1.0):
        ranks = {r["k"]: r["value"] for r in selection.nearest_rank(df, ["k"], "x", level).collect()}
        assert ranks == {k: np.sort(y)[max(1, math.ceil(level * len(y))) - 1] for k, y in groups.items()}
    assert selection.quantiles(df, [], "x", [0.5]).collect()[0]["q"][0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_brackets_leave_most_rows_in_the_map_tasks(spark):
    """A group of 200,000 different values comes to few cells."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.xxhash64("id") / 1e12).alias("x"))
    c = selection.cells(df, ["k"], "x", [0.5, 0.99])
    n, least, most = c.agg(F.count(F.lit(1)), F.min("before"), F.max("upto")).first()
    assert n < 4 * 2 * selection.SLACK * 200_000 / selection.ACCURACY and (least, most) == (0, 200_000)
    x = np.sort(df.toPandas()["x"].to_numpy())
    assert selection.nearest_rank(df, ["k"], "x", 0.99).first()["value"] == x[197_999]
    assert dist.quantiles(df, ["k"], "x", (0.5,)).first()["q50"] == pytest.approx(np.median(x))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x float, ROW int")
    assert selection.quantiles(df, ["k"], "x", [0.5]).collect() == []
    assert selection.nearest_rank(df, ["k"], "x", 0.99).collect() == []
    assert thresholds.exact(df, "x").collect() == []
    assert trend.trends(df.withColumn("YEAR", F.col("ROW")), ["k"], "x").collect() == []


@pytest.mark.parametrize("few", [thresholds.FEW, 2])
def test_cells_that_are_read_again(spark, tmp_path, monkeypatch, few):
    """Named to the files while they are few, and by a join alone beyond that: the same thresholds."""
    monkeypatch.setattr(thresholds, "FEW", few)
    rng = np.random.default_rng(6)
    rows = [(r, float(np.float32(v))) for r in range(20) for v in rng.gamma(2, 60 if r % 4 == 0 else 5, 150)]
    spark.createDataFrame(rows, "ROW int, x float").repartition(1).sortWithinPartitions("ROW").write.parquet(str(tmp_path / "f"))
    cells = spark.read.parquet(str(tmp_path / "f"))
    hist = thresholds.histogram(cells, "x")
    plain = {tuple(r) for r in thresholds.refined(cells, "x").collect()}
    kept = thresholds.refined(cells, "x", hist=hist)
    assert {tuple(r) for r in kept.collect()} == plain and {r[3] for r in plain} == {"histogram", "exact"}
    scans = kept._jdf.queryExecution().executedPlan().toString()
    assert ("PushedFilters: [In(ROW" in scans) == (few > 2)
    exact = {r: np.sort([v for k, v in rows if k == r and v > np.float32(0.3)]) for r in range(0, 20, 4)}
    assert {r: p for r, _, p, how in plain if how == "exact"}.items() <= {r: v[math.ceil(0.99 * len(v)) - 1] for r, v in exact.items()}.items()
