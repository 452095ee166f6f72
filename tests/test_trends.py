import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluvia.operators import bands, bootstrap, decompose, trend


def sen(t, y):
    s = [(y[j] - y[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[j] > t[i]]
    return float(np.median(s)) if len(t) >= 3 else None


def mk(y):
    n = len(y)
    if n < 3:
        return None
    s = sum(np.sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
    ties = sum(c * (c - 1) * (2 * c + 5) for c in np.unique(y, return_counts=True)[1])
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    return 1.0 if var <= 0 else math.erfc(abs(s - np.sign(s)) / math.sqrt(var) / math.sqrt(2))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.integers(-3, 3).map(float), st.none(), st.just(float("nan"))), min_size=1, max_size=12), min_size=1, max_size=6))
def test_slopes_and_tests_of_any_series(spark, series):
    rows = [(k, 2000 + i, y) for k, ys in enumerate(series) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "k int, YEAR int, y double")
    slopes, joined, p = (dict(map(tuple, d.collect())) for d in (trend.theil_sen(df, ["k"], "y", per=1.0), trend.slopes_by_join(df, ["k"], "y", per=1.0), trend.mann_kendall(df, ["k"], "y")))
    for k, ys in enumerate(series):
        ok = [(2000 + i, y) for i, y in enumerate(ys) if y is not None and y == y]
        t, y = [a for a, _ in ok], [b for _, b in ok]
        want = sen(t, y)
        assert slopes[k] == (None if want is None else pytest.approx(want)) and joined.get(k) == slopes[k] or pytest.approx(joined.get(k)) == slopes[k]
        want = mk(y)
        assert p[k] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_slopes_do_not_add_up(spark):
    a, b = [0, 1, 4, 2, 8, 3, 9, 4], [5, 1, 7, 2, 0, 9, 3, 3]
    rows = [(k, i, float(v)) for k, s in (("a", a), ("b", b), ("c", [x + y for x, y in zip(a, b, strict=True)])) for i, v in enumerate(s)]
    s = dict(map(tuple, trend.theil_sen(spark.createDataFrame(rows, "k string, YEAR int, y double"), ["k"], "y").collect()))
    assert abs(s["a"] + s["b"] - s["c"]) > 0.1


def test_two_intercepts(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 9, 3, 5])], "k int, YEAR int, y double")
    joint, apart = ({r["YEAR"]: r for r in trend.sen_line(df, ["k"], "y", joint=j).collect()} for j in (True, False))
    y, t = np.array([1, 2, 9, 3, 5.0]), np.arange(5.0)
    m = sen(t, y)
    assert joint[0]["intercept"] == pytest.approx(np.median(y - m * t)) and apart[0]["intercept"] == pytest.approx(np.median(y) - m * np.median(t))
    assert joint[2]["fit"] + joint[2]["residual"] == pytest.approx(9)
    flat = trend.sen_line(df.where("YEAR < 2"), ["k"], "y").collect()
    assert {r["slope"] for r in flat} == {0.0} and {r["intercept"] for r in flat} == {1.5}


def decade(spark, gap=False, hemi="NH"):
    rng = np.random.default_rng(1)
    lats = {"NH": (5.0, 20.0, 30.0, 40.0), "SH": (-5.0, -12.0, -17.0, -40.0)}[hemi]
    rows = [(y, hemi, lat, "NA", float(10 + k + 0.1 * (y - 2000) + rng.random())) for y in range(2000, 2010) for k, lat in enumerate(lats) for _ in range(10 + 2 * k) if not (gap and y == 2002 and k == 1)]
    return spark.createDataFrame(rows, "YEAR int, HEMISPHERE string, TC_LAT double, BASIN string, EVENT_INTENSITY_MM_3H double")


@pytest.mark.parametrize("gap", [False, True])
def test_decomposition_closes(spark, gap):
    ev = decade(spark, gap)
    b = bands.annual_bands(ev, ["HEMISPHERE"], (2000, 2009))
    assert b.count() == 40
    parts = decompose.components(b, ["HEMISPHERE"]).orderBy("YEAR").collect()
    plain = {r["YEAR"]: r["m"] for r in ev.groupBy("YEAR").agg(F.avg("EVENT_INTENSITY_MM_3H").alias("m")).collect()}
    assert all(abs(r["CLOSURE_ERROR"]) < 1e-10 and r["ANNUAL_MEAN"] == pytest.approx(plain[r["YEAR"]]) for r in parts)


def test_errors_of_the_strict_path(spark):
    ev = decade(spark)
    bad = ev.unionByName(ev.limit(1).withColumn("TC_LAT", F.lit(95.0)))
    with pytest.raises(Exception, match="outside the latitude bands"):
        bands.annual_bands(bad, ["HEMISPHERE"], (2000, 2009)).collect()
    assert bands.annual_bands(bad, ["HEMISPHERE"], (2000, 2009), strict=False).agg(F.sum("N_EVENTS")).first()[0] == ev.count()
    with pytest.raises(Exception, match="no events in any year"):
        decompose.components(bands.annual_bands(ev.where("TC_LAT < 35"), ["HEMISPHERE"], (2000, 2009)), ["HEMISPHERE"]).collect()
    with pytest.raises(Exception, match="a year has no events"):
        decompose.components(bands.annual_bands(ev, ["HEMISPHERE"], (1999, 2009)), ["HEMISPHERE"]).collect()


def test_empty_band_has_no_terms(spark):
    ev = decade(spark).where("TC_LAT < 35")
    b = bands.annual_bands(ev, ["HEMISPHERE"], (2000, 2009))
    last = {r["BAND"]: r for r in decompose.band_terms(b, ["HEMISPHERE"]).collect()}[3]
    assert (last["migration"], last["intensity"], last["total"]) == (0, 0, 0)


def test_events_weigh_alike(spark):
    """An event is one, however many cells it has."""
    rows = [(2000, "NH", 5.0, "WP", 10.0), (2000, "NH", 6.0, "WP", 30.0)]
    ev = spark.createDataFrame(rows, "YEAR int, HEMISPHERE string, TC_LAT double, BASIN string, EVENT_INTENSITY_MM_3H double")
    got = {r["domain"]: r["mean"] for r in bands.annual_means(ev).collect()}
    assert got == {"GLOBAL": 20.0, "NH": 20.0}


def test_draws():
    d = bootstrap.block_draws(44, 4, 3, 42)
    assert d.shape == (3, 44) and d[0, ::4].tolist() == [3, 31, 26, 17, 17, 35, 3, 28, 8, 3, 21]
    assert (np.diff(d[0].reshape(-1, 4), axis=1) == 1).all()
    assert bootstrap.block_draws(10, 4, 2, 1).shape == (2, 10)
    for block in (0, 11):
        with pytest.raises(ValueError):
            bootstrap.block_draws(10, block, 1, 1)


def test_bootstrap_against_numpy(spark):
    parts = decompose.components(bands.annual_bands(decade(spark), ["HEMISPHERE"], (2000, 2009)), ["HEMISPHERE"])
    ci = {r["COMPONENT"]: r for r in bootstrap.component_intervals(parts, ["HEMISPHERE"], repetitions=40, block=3, seed=7).collect()}
    band = bootstrap.fit_bands(parts, ["HEMISPHERE"], "ANNUAL_MEAN", joint=False, repetitions=40, block=3, seed=7).collect()
    assert set(ci) == set(decompose.TRENDED) and len(band) == 10
    y = np.array([r["ANNUAL_MEAN"] for r in parts.orderBy("YEAR").collect()])
    t = np.arange(2000.0, 2010.0)
    m = sen(t, y)
    fit = np.median(y) - m * np.median(t) + m * t
    slopes, lines = [], []
    for d in bootstrap.block_draws(10, 3, 40, 7):
        star = fit + (y - fit)[d]
        s = sen(t, star)
        slopes.append(10 * s)
        lines.append(np.median(star) - s * np.median(t) + s * t)
    assert (ci["TOTAL"]["ci_low"], ci["TOTAL"]["ci_high"]) == pytest.approx(tuple(np.quantile(slopes, [0.025, 0.975])))
    low = {r["YEAR"]: r["fit_lower"] for r in band}
    assert [low[int(x)] for x in t] == pytest.approx(np.quantile(lines, 0.025, axis=0).tolist())
    with pytest.raises(Exception, match="missing or infinite"):
        bootstrap.replicates(parts.withColumn("ANNUAL_MEAN", F.lit(None).cast("double")), ["HEMISPHERE"], "ANNUAL_MEAN").collect()


def test_band_intervals_against_numpy(spark):
    b = bands.annual_bands(decade(spark), ["HEMISPHERE"], (2000, 2009))
    got = {r["BAND"]: r for r in bootstrap.band_intervals(b, ["HEMISPHERE"], repetitions=15, block=4, seed=42).collect()}
    rows = sorted(b.collect(), key=lambda r: (r["YEAR"], r["BAND"]))
    n, v = (np.array([r[c] for r in rows], float).reshape(10, 4) for c in ("N_EVENTS", "INTENSITY_SUM"))
    t = np.arange(2000.0, 2010.0)

    def line(y):
        m = sen(t, y)
        f = np.median(y - m * t) + m * t
        return f, y - f

    def terms(n, v):
        total = n.sum(1, keepdims=True)
        a, p, q = n / total, v / n, v / total
        mig = np.array([10 * sen(t, a[:, k]) * p[:, k].mean() for k in range(4)])
        inten = np.array([a[:, k].mean() * 10 * sen(t, p[:, k]) for k in range(4)])
        tot = np.array([10 * sen(t, q[:, k]) for k in range(4)])
        return mig, inten, tot

    lines = [[line(x[:, k]) for k in range(4)] for x in (n, v)]
    reps = []
    for d in bootstrap.block_draws(10, 4, 15, 42):
        star = [np.stack([np.clip(f + r[d], 0, None) for f, r in x], axis=1) for x in lines]
        reps.append(terms(*star))
    mig, inten, tot = terms(n, v)
    for k in range(4):
        assert (got[k]["migration_point"], got[k]["intensity_point"], got[k]["total_point"]) == pytest.approx((mig[k], inten[k], tot[k]))
        assert got[k]["total_ci_low"] == pytest.approx(np.quantile([r[2][k] for r in reps], 0.025))
        assert got[k]["migration_ci_high"] == pytest.approx(np.quantile([r[0][k] for r in reps], 0.975))


def test_null_keys_stay_and_repeated_ones_are_errors(spark):
    df = spark.createDataFrame([(k, 2000 + i, float(i * (2 if k else 1))) for k in ("a", None) for i in range(5)], "k string, YEAR int, y double")
    t = trend.trends(df, ["k"], "y")
    ci = bootstrap.trend_intervals(df, ["k"], "y", block=2, repetitions=20)
    got = {r["k"]: r for r in decompose.significance(t, ci, ["k"]).collect()}
    assert got["a"]["slope"] == pytest.approx(20) and got[None]["slope"] == pytest.approx(10) and got[None]["significant"]
    with pytest.raises(Exception, match="one to one"):
        decompose.significance(t, ci.unionByName(ci.where("k = 'a'")), ["k"]).collect()
    b = spark.createDataFrame([(None, y, k, 1 + (y + k) % 3, float(y - k)) for y in range(2000, 2006) for k in range(4)], "h string, YEAR int, BAND int, N_EVENTS int, INTENSITY_SUM double")
    assert decompose.band_terms(b, ["h"]).count() == 4
    assert bootstrap.band_intervals(b, ["h"], block=2, repetitions=10).count() == 4
    with pytest.raises(Exception, match="gaps or repeated"):
        bootstrap.band_intervals(b.where("YEAR > 2000 OR BAND > 0"), ["h"], block=2, repetitions=10).collect()
