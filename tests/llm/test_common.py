import random

import pytest

from pluvia.llm import common


def plain(edges):
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        comp[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(comp)}


def test_components(spark):
    """Stars, chains, repeated edges, both directions."""
    rng = random.Random(4)
    edges = [(i, 7) for i in range(40)] + [(100 + i, 101 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    edges += [(v, u) for u, v in edges[::3]] + edges[:5]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = plain([e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_values_go_back_to_hot_keys(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE cast(id AS string) END AS k")
    got = common.group_min(rows, "k", "id", "id", "m")
    assert got.count() == 3000 and got.where("k = 'hot' AND m <> 1").isEmpty() and got.where("k <> 'hot' AND m <> id").isEmpty()
    assert common.salt_of("id") is not None and rows.select(common.salt_of("id").alias("s")).distinct().count() == common.SALTS


def test_shared_folder(spark):
    """Tables lie below the session's checkpoint folder, are read back as they were, and can be discarded."""
    path = common.shared_dir(spark)
    assert common.shared_dir(spark) == path
    df = common.stored(spark.range(5).selectExpr("id", "array(id) AS a"), "x")
    assert sorted(map(tuple, df.collect())) == [(i, [i]) for i in range(5)] and df.inputFiles()[0].startswith(path.replace("file:/", "file:///").replace("file://////", "file:///")[:12])


def test_runs():
    assert list(common.runs([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(common.runs([], 10)) == [] and list(common.runs([99], 10)) == [(0, 1)]


def test_components_of_few_edges_are_not_salted(spark, monkeypatch):
    """A round on few edges is two windows; with more edges the salted form gives the same."""
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200), (301, 300)]
    e = spark.createDataFrame(edges, "u long, v long")
    monkeypatch.setattr(common, "FEW_EDGES", 0)
    salted = sorted(map(tuple, common.components(e).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(common, "group_min", None)
    assert sorted(map(tuple, common.components(e).collect())) == salted
    assert salted == [(k, 0) for k in range(60)] + [(k, 100) for k in range(100, 131)] + [(300, 300), (301, 300)]
