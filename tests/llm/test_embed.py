import math
import random

import numpy as np
import pytest

from pluvia.llm import embed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, keys string"


def usable(v, label=0):
    return v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, link=0.93):
    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v, lab) else None for _, v, lab, *_ in rows]
    comp, deg = list(range(n)), [0] * n
    edges = [(i, j) for i in range(n) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= link]
    for i, j in edges:
        deg[i] += 1
        deg[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    ids = [r[0] for r in rows]
    return deg, [min((ids[k] for k in range(n) if comp[k] == comp[i] and ids[k] is not None), default=None) for i in range(n)]


def vectors(seed=5, d=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for lab in (0, 1, None):
        for size in (1, 2, 7, 40):
            c = rng.normal(size=d)
            for _ in range(size):
                rows.append((i, (c + rng.normal(size=d) * 0.08).tolist(), lab, 1, "k"))
                i += 1
    rows += [(900 + k, rows[3][1], 0, 1, "k") for k in range(4)] + [(910, rows[3][1], 1, 1, "k")]
    rows += [(920, None, 0, 1, "k"), (921, [0.0] * d, 0, 1, "k"), (922, [1.0, None] * (d // 2), 0, 1, "k"), (923, [float("nan")] * d, 0, 1, "k"), (924, [], 0, 1, "k"), (925, [1.0] * 3, 0, 1, "k"), (926, [1.0] * 3, 0, 1, "k"), (927, [float("inf")] + [1.0] * (d - 1), 0, 1, "k")]
    return rows


@pytest.mark.parametrize("most", [{}, {"piece": 7, "block": 5}])
def test_links_and_components(spark, monkeypatch, most):
    if most:  # keys of several projections, in rows of several batches
        monkeypatch.setattr(embed, "BUCKET", 2)
    rows = vectors()
    got = {r["vec_id"]: r for r in embed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **most).collect()}
    deg, comp = plain(rows)
    for (i, *_), n, c in zip(rows, deg, comp, strict=True):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i), i
    assert len(got) == len(rows) and max(deg) > 30


def test_null_and_repeated_ids_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(7, v, 0, 0, ""), (7, v, 0, 0, ""), (None, v, 0, 0, ""), (None, [3.0, -1.0, 0.0], 0, 0, "")]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 0, None)], key=str)
    assert embed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("classes", [40, 5000, 10**7])
def test_collision_probability(classes):
    """Near pairs at the threshold miss all tables rarely, and differ in few signs; unrelated ones share keys as the rule says."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * o
    lab = np.zeros(len(a), np.int64)
    shape = embed.shape_for(classes)
    ka, kb, ko = (embed.keys_of(x, lab, *shape) for x in (a, b, o))
    assert (ka == kb).any(axis=1).mean() > 0.994
    assert classes * (ka == ko).mean() < 3 * embed.BUCKET
    sa, sb, so = (embed.signs_of(x) for x in (a, b, o))
    assert np.bitwise_count(sa ^ sb).sum(axis=1).max() <= embed.FAR < np.bitwise_count(sa ^ so).sum(axis=1).min()


def test_very_small_and_large_vectors(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [1e170, 2e170]), (3, [1.0, 2.0]), (4, [2.0, -1.0]), (5, [1e-320, 2e-320])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4)}


def test_all_rows_of_a_table(spark, data):
    from pluvia.sources.tables import table

    if not (data / "check_s").exists():
        pytest.skip("no table with near copies")
    e = table(spark, f"{data}/check_s", "embeddings").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in e.collect()]
    x = np.array([r[1] if usable(r[1]) else [0.0] * 64 for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & (label >= 0)[:, None]
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r["n_links"] for r in embed.near_duplicates(e).collect()}
    assert [got[r[0]] for r in rows] == hit.sum(1).tolist() and hit.any()
