import zlib

import numpy as np
import pytest

from pluvia.llm import quality, wordscan
from pluvia.llm.common import crc_bucket
from pluvia.sources.tables import table


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out(spark, data):
    docs, labels = table(spark, f"{data}/sf0.1", "documents"), table(spark, f"{data}/sf0.1", "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.97 and (got.predicted == (got.score >= 0.3)).all()


def test_scores_are_sparse_dot_products(monkeypatch):
    texts = [b"Some words *** here", b"", b"a", b"THE END!! 12 %% " * 30]
    w = np.random.default_rng(1).normal(size=1 << 12).astype(np.float32)
    want = [sum(v * w[i] for i, v in zip(*quality._sparse(t, 12), strict=True)) for t in texts]
    assert quality.averages(texts, w) == pytest.approx(want, rel=1e-4, abs=1e-6)
    monkeypatch.setattr(wordscan, "PIECE", 64)
    assert quality.averages(texts[:3], w) == pytest.approx(want[:3], rel=1e-4, abs=1e-6)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(16, 4, replace=False)), rng.random(4), int(rng.integers(2))) for _ in range(30)]
    w, bias = quality.fit(rows, bits=4, epochs=2)
    z, n = np.zeros(17), np.zeros(17)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for idx, val, y in rows:
            x = {**dict(zip(idx.tolist(), val, strict=True)), 16: 1.0}
            old = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(old[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * old[i]
                n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(16)], atol=1e-5) and bias == pytest.approx(weight(16))


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, None), (4, 1, 0), (99999, 0, 0), (None, 1, 1), (12, None, 0), (13, 7, 0), (100, 0, 0), (100, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).toPandas()
    assert len(got) == len(odd_rows) and got.score.between(0, 1).all()
    blank = got[got.doc_id.isin([1, 2, 21])].score
    assert blank.nunique() == 1
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(odd, labels.where("false")).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 1).all()
    model = quality.learn(odd, labels, crc_bucket("doc_id", 5) != 0)
    kept = quality.passing(odd, model)
    assert kept.columns == odd.columns and kept.count() == got.predicted.sum()


def test_n_grams_over_the_borders_of_pieces(monkeypatch):
    """A text that is cut scores as the same text whole."""
    import numpy as np

    from pluvia.llm import wordscan

    rng = np.random.default_rng(3)
    w = rng.normal(size=1 << quality.BITS).astype(np.float32)
    text = " ".join("".join(rng.choice(list("abcdeXYZ019.!"), rng.integers(1, 9))) for _ in range(4000)).encode()
    whole, sparse = quality.averages([b"a b", text, b"c"], w), quality._sparse(text, quality.BITS)
    for size in (300, 1001):
        monkeypatch.setattr(wordscan, "PIECE", size)
        monkeypatch.setattr(wordscan.split_long, "__defaults__", (size,))
        assert np.allclose(quality.averages([b"a b", text, b"c"], w), whole)
        again = quality._sparse(text, quality.BITS)
        assert np.array_equal(again[0], sparse[0]) and np.allclose(again[1], sparse[1])
