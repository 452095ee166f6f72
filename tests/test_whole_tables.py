"""Queries that read whole tables, against plain Python over all rows."""

import math
from collections import Counter
from datetime import timedelta

import duckdb
import numpy as np
import pytest

from pluvia.operators import bootstrap
from pluvia.plans import base, records, series


def read(data, columns, name):
    return duckdb.sql(f"SELECT {columns} FROM '{data}/sf0.001/{name}.parquet'").fetchall()


def anchors(data):
    """{SID: {TIME: (LAT, LON, wind)}} of all orders."""
    out = {}
    for key, cust, date in read(data, "o_orderkey, o_custkey, o_orderdate", "orders"):
        sid = f"T{cust % 60}-{date:%Y%m}-{key // 150000}"
        t = date.replace(day=1) + timedelta(hours=6 * (key % 30) + 3 * (cust % 60 == 7))
        row = ((key % 80 - 40) / 2, (340 + key % 40) % 360.0, float(key % 150) if key % 4 else None)
        at = out.setdefault(sid, {})
        order = lambda r: (*r[:2], r[2] is None, r[2] or 0)
        at[t] = min(at.get(t, row), row, key=order)
    return out


def test_tracks_of_all_orders(spark, data):
    root = f"{data}/sf0.001"
    want = anchors(data)
    assert records.all_raw_rows(spark, root).count() == len(read(data, "o_orderkey", "orders"))
    ticks = {}
    for sid, at in want.items():
        first, last = min(at), max(at)
        for k in range((last - first) // timedelta(hours=3) + 1):
            t = first + k * timedelta(hours=3)
            if t in at or first.hour % 6 == 0:
                ticks[sid, f"{t:%Y-%m-%d %H:%M:%S}"] = at.get(t)
    got = {(r["SID"], r["TIME"]): r for r in records.track_prepare(spark, root).collect()}
    assert got.keys() == ticks.keys() and len({k[0].split("-")[1] for k in got}) == 80
    assert all((got[k]["LAT"], round(got[k]["LON"], 6)) == v[:2] for k, v in ticks.items() if v)
    some = {(r["SID"], r["TIME"]) for r in records.prepared_all(spark, root, 1996, 1998).collect()}
    assert some == {k for k in ticks if "1996" <= k[1][:4] <= "1998"} and 0 < len(some) < len(ticks)
    six = {(s, f"{t:%Y-%m-%d %H:%M:%S}") for s, at in want.items() for t in at if t.hour % 6 == 0}
    assert {(r["SID"], r["TIME"]) for r in records.track_unwrap(spark, root).collect()} == six


def test_regions_of_all_rows(spark, data):
    """Union-find over the cells of every row."""
    root, parent = f"{data}/sf0.001", {}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for key, part, supp, quantity in read(data, "l_orderkey, l_partkey, l_suppkey, l_quantity", "lineitem"):
        c = key // 100, 900 + part % 24, -12 + supp * 5 % 24 + int(quantity) % 2  # columns from longitude 0
        parent.setdefault(c, c)
    for k, i, j in list(parent):
        for other in ((k, i + 1, j), (k, i, j + 1)):
            if other in parent:
                a, b = sorted((find((k, i, j)), find(other)))
                parent[b] = a
    row = lambda c: c[1] * 3600 + c[2] % 3600
    regions = {}
    for c in parent:
        regions.setdefault(find(c), []).append(c)
    got = records.connected_components(spark, root).collect()
    assert {(r["k"], r["ROW"]): r["FEATURE"] for r in got} == {(c[0], row(c)): row(find(c)) for c in parent} and len(got) == len(parent)
    assert {c[0] for c in parent} == set(range(15)) and len(regions) > 100

    def near(cells):
        la, lo = (sum(x) / len(cells) for x in ([89.95 - c[1] * 0.1 for c in cells], [c[2] * 0.1 + 0.05 for c in cells]))
        return 6371 * math.acos(math.cos(math.radians(la)) * math.cos(math.radians(lo))) <= 200

    want = {(c[0], row(c)) for cells in regions.values() if near(cells) for c in cells}
    assert {(r["k"], r["ROW"]) for r in records.feature_centroid_filter(spark, root).collect()} == want and 0 < len(want) < len(parent)


def test_ties_of_all_rows(spark, data):
    sums = Counter()
    for flag, line, quantity, part in read(data, "l_returnflag, l_linenumber, l_quantity, l_partkey", "lineitem"):
        sums[flag, line * 100 + int(quantity)] += part
    got = {r["k"]: r for r in series.mann_kendall_ties(spark, f"{data}/sf0.001").collect()}
    assert got.keys() == {k for k, _ in sums}
    for k, r in got.items():
        y = [v % 5 for (_, _), v in sorted(x for x in sums.items() if x[0][0] == k)]
        n = len(y)
        s = sum((b > a) - (b < a) for i, a in enumerate(y) for b in y[i:])
        var = (n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in Counter(y).values())) / 18
        p = math.erfc(abs((s - (s > 0) + (s < 0)) / var**0.5) / 2**0.5)
        assert (r["n"], r["s"], r["var"], r["p_value"]) == (n, s, pytest.approx(var, abs=1e-5), pytest.approx(p, abs=1e-5)) and n > 250


def test_a_thousand_replicates(spark, data):
    root = f"{data}/sf0.001"
    got = {r["HEMISPHERE"]: r for r in base.QUERIES["bootstrap_trend_ci"](spark, root).where("COMPONENT = 'TOTAL'").collect()}
    rows = sorted((r["HEMISPHERE"], r["YEAR"], r["ANNUAL_MEAN"]) for r in series.parts(spark, root).collect())
    i, j = np.triu_indices(7, 1)
    for h, r in got.items():
        t, y = (np.array([x[c] for x in rows if x[0] == h], float) for c in (1, 2))
        sen = lambda v: np.median((v[j] - v[i]) / (t[j] - t[i]))  # noqa: E731, B023
        fit = np.median(y) - sen(y) * np.median(t) + sen(y) * t
        s = [10 * sen(fit + (y - fit)[d]) for d in bootstrap.block_draws(7, 4, 1000, 42)]
        assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(s, [0.025, 0.975])), abs=2e-6)
    assert len(got) == 2
