import collections
import math
import zlib

import numpy as np
import pytest

from pluvia.llm import lm
from pluvia.sources.tables import table


def plain(rows):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = collections.Counter(w for (d, _), ws, h in zip(rows, tokens, held, strict=True) if d is not None and not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(d, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws, h in zip(rows, tokens, held, strict=True)]


def check(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and math.isfinite(g[6]) and g[6] <= 0


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_base_and_counts(spark, data, monkeypatch, most):
    """Also with few words for every task, so that most counts come by the join."""
    monkeypatch.setattr(lm.lexicon, "__defaults__", (most,))
    docs = table(spark, f"{data}/sf0.001", "documents")
    check(lm.evaluate(docs).collect(), plain([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_model_beats_the_base_on_held_out_texts(spark, data):
    got = lm.evaluate(table(spark, f"{data}/sf0.01", "documents")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.1


def test_probabilities_are_normalised():
    lex = lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(256), np.full(768, 1 / 768), 0, 0)
    t = lm.Trainer(lm.start(lex), lex.unigram, 1)
    rng = np.random.default_rng(3)
    w = rng.integers(0, 50, 3000)
    for _ in range(5):
        t.feed(*lm.contexts(w, np.array([len(w)])), w)
        t.flush()
    t1, t2, z = lm.tables(t.p)
    for a, b in ((0, 0), (3, 700), (49, 12)):
        assert np.exp(t1[a] + t2[b] - z[a, b]).sum() == pytest.approx(1, rel=1e-4)


def test_training_learns_what_follows_what():
    w = np.tile([1, 2, 3, 4], 4000)
    uni = np.full(768, 1e-6)
    uni[1:5] = 0.25
    lex = lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(256), uni / uni.sum(), 0, 0)
    t = lm.Trainer(lm.start(lex), lex.unigram, 1)
    for _ in range(10):
        t.feed(*lm.contexts(w, np.array([len(w)])), w)
        t.flush()
    t1, t2, z = lm.tables(t.p)
    assert np.exp(t1[1, 2] + t2[4, 2] - z[1, 4]) > 0.8


def test_contexts_stop_at_texts():
    ids = np.array([5, 6, 0, 7, 0])
    c1, c2 = lm.contexts(ids, np.array([3, 2]))
    assert c1.tolist() == [0, 5, 6, 0, 7] and c2.tolist() == [0, 0, 5, 0, 0]


def test_odd_rows(spark, odd, odd_rows, empty):
    check(lm.evaluate(odd).collect(), plain([(r[0], r[1]) for r in odd_rows]))
    assert lm.evaluate(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "some words"), (held, None)], "doc_id long, text string")
    got = lm.evaluate(only).collect()
    assert [r["train_tokens"] for r in got] == [0, 0] and all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
