import numpy as np
import pyarrow as pa
import pytest

from pluvia.llm import ann
from pluvia.llm.vectors import lists, matrix
from pluvia.sources.tables import table

from .test_embed import SCHEMA, usable, vectors


def exact(rows, every=20, top=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if usable(v)]
    d = max((len(v) for _, v in good), key=[len(v) for _, v in good].count)
    good = [(i, v) for i, v in good if len(v) == d]
    last = lambda i: (i is None, i or 0)
    return {q: sorted(((-float(np.cumsum(x * v)[-1]), i) for i, x in good if i != q), key=lambda t: (t[0], last(t[1])))[:top] for q, v in good if q is not None and q % every == 0}


def same(got, want):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert set(by) == set(want)
    for q, found in by.items():
        found.sort(key=lambda t: t[0])
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        assert [(round(s, 9), i) for _, s, i in found] == [(round(s, 9), i) for s, i in want[q]]


@pytest.mark.parametrize("piece", [16, 1 << 16])
def test_search_finds_all_when_it_walks_far_enough(spark, piece):
    rows = [*vectors(8), (None, vectors(8)[3][1], 0, 1, "k")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(ann.search(df, every=5, top=6, recall=1.0, piece=piece, least_piece=8).collect(), exact(rows, 5, 6))


def test_small_and_odd_tables(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, ""), (3, [1.0, 2.0], 0, 0, ""), (20, None, 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in ann.search(two).collect()] == [(0, 1, 3, 5.0)]
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.search(two.where("vec_id = 3")).count() == 0 and ann.search(two.where("vec_id = 20")).count() == 0
    again = spark.createDataFrame([(0, [1.0, 2.0]), (0, [0.0, 3.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in ann.search(again).orderBy("rank").collect()] == [(1, 1, 0.0), (2, 2, 0.0), (3, None, 0.0)]
    wide = spark.createDataFrame([(i, "x", 1, [float(i % 7), 1.0, float(i)]) for i in range(60)], "vec_id long, score string, `rank` int, embedding array<double>")
    assert ann.search(wide).count() == 60


def clustered(n, d, rng):
    c = rng.normal(size=(40, d))
    return c[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["sphere", "clusters", "sf0.1", "sf0.01"])
def test_recall_where_cells_are_left_out(spark, data, monkeypatch, kind):
    """One rule at every size: recall is 0.9 at least, and from 10,000 vectors on a fifth of them is reranked at most."""
    rng = np.random.default_rng(1)
    if kind.startswith("sf"):
        e = table(spark, f"{data}/{kind}", "embeddings")
    else:
        many = rng.normal(size=(12_000, 64)) if kind == "sphere" else clustered(12_000, 64, rng)
        many /= np.linalg.norm(many, axis=1)[:, None]
        e = spark.createDataFrame(list(enumerate(many.tolist())), "vec_id long, embedding array<double>")
    depths, measure = [], ann.measured_depth
    monkeypatch.setattr(ann, "measured_depth", lambda *a: depths.append(measure(*a)) or depths[0])
    got = {}
    for r in ann.search(e).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = e.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    assert 0.9 <= np.mean(hits) < 1
    assert depths[0] < len(ids) * (0.2 if len(ids) >= 10_000 else 0.5)


def test_reach_is_that_of_the_cells_in_order():
    rng = np.random.default_rng(3)
    for k, n in ((6, 30), (40, 500), (3, 9)):
        cells = np.unique(rng.integers(0, k * k, n))
        own = ann.Index(np.zeros((k, 2)), np.zeros((k, 2)), cells // k, cells % k, rng.integers(1, 5, len(cells)))
        for depth in (1, 7, int(own.n.sum() // 2), int(own.n.sum()), 10**9):
            d1, d2 = rng.normal(size=k), rng.normal(size=k)
            sums = d1[own.i] + d2[own.j]
            order = np.argsort(sums)
            held = np.cumsum(own.n[order])
            assert own.reach(d1, d2, depth) == sums[order[min(np.searchsorted(held, depth), len(order) - 1)]]


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_only_entries_in_reach_are_multiplied(kind):
    rng = np.random.default_rng(5)
    n, half = 10_000, 32
    x = rng.normal(size=(n, 64)) if kind == "sphere" else clustered(n, 64, rng)
    x /= np.linalg.norm(x, axis=1)[:, None]
    k = int(ann.PER_ROOT * n**0.5)
    own = ann.Index(ann.kmeans(x[:, :half], k, 2), ann.kmeans(x[:, half:], k, 2), *np.zeros((3, 0), np.int64))
    i, j = own.codes(x)
    cells, own.n = np.unique(i * k + j, return_counts=True)
    own.i, own.j = cells // k, cells % k
    ids = rng.permutation(n)
    piece = ann.Piece(ids, x, i, j)
    q = x[:40]
    d1, d2 = own.distances(q)
    reach = np.array([own.reach(a, b, n // 5) for a, b in zip(d1, d2, strict=True)]) + 1e-9
    r, named, s = piece.best(ids[:40], q, d1, d2, reach, 20)
    products = 0
    for a in range(40):
        near = d1[a, i] + d2[a, j] <= reach[a]
        products += len(piece.within(d1[a], d2[a], reach[a]))
        assert sorted(piece.ids[piece.within(d1[a], d2[a], reach[a])]) == sorted(ids[near])
        score = np.where(near & (ids != ids[a]), np.cumsum(x * q[a], axis=1)[:, -1], -np.inf)
        best = np.lexsort((ids, -score))[:20]
        assert named[r == a].tolist() == ids[best].tolist() and s[r == a].tolist() == score[best].tolist()
    assert n // 5 * 40 <= products <= n * 40 // 2
    none = piece.best(ids[:1], q[:1], d1[:1], d2[:1], np.array([-np.inf]), 20)
    assert [len(c) for c in none] == [0, 0, 0]


def test_matrix_of_a_sliced_column():
    c = pa.array([[9.0, 9.0], None, [1.0, 2.0], [1.0, None], [0.0, 0.0], [float("nan"), 1.0], [3.0], [4.0, 5.0]], pa.list_(pa.float32())).slice(1)
    rows, x = matrix(c, 2)
    assert rows.tolist() == [1, 6] and x.tolist() == [[1.0, 2.0], [4.0, 5.0]]
    assert lists(x).to_pylist() == [[1.0, 2.0], [4.0, 5.0]]


@pytest.mark.parametrize("kind", ["plane", "clusters", "repeats"])
def test_every_query_gets_all_its_rows(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "plane":
        ids, x = np.arange(400), rng.standard_normal((400, 2))
    elif kind == "clusters":
        ids, x = np.arange(600), rng.standard_normal((6, 16))[rng.integers(0, 6, 600)] + 0.01 * rng.standard_normal((600, 16))
    else:
        ids, x = np.concatenate([np.arange(100), np.full(60, 40)]), rng.standard_normal((160, 4))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann.search(df).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in got} == {int(i) for i in ids if i % 20 == 0}
    assert {r["count"] for r in got} == {20}
