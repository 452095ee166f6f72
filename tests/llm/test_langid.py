import zlib

import numpy as np

from pluvia.llm import langid
from pluvia.sources.tables import table


def plain_vector(text, dims, seed):
    """A bundle by loops over words and trigrams."""
    out = np.zeros(dims)
    word = "".join(c if c.isalpha() else " " for c in text.lower())
    for w in word.split():
        w = f" {w} "
        for i in range(len(w) - 2):
            v = np.ones(dims)
            for k, c in enumerate(w[i : i + 3]):
                v *= np.roll(langid._letter_vector(ord(c) if c != " " else 0, dims, seed), 2 - k)
            out += v
    return out


def test_bundles_match_loops():
    texts = ["Hello, world", "", "é", "a b", "İstanbul ΑΣ x1y", "zzz zzz"]
    got = langid.bundle(texts, 64, 3)
    for t, v in zip(texts, got, strict=True):
        assert np.array_equal(v, plain_vector(t, 64, 3)), t


def test_groups_and_long_texts(monkeypatch):
    monkeypatch.setattr(langid, "_GROUP", 50)
    monkeypatch.setattr(langid, "_CELLS", 1)
    texts = ["abc def " * 3, "ghi", "jkl mno", "abc"]
    by_text = langid.bundle(texts, 32, 1)
    assert np.allclose(by_text[1], plain_vector("ghi", 32, 1))
    assert np.allclose(langid.bundle(texts, 32, 1, np.array([1, 0, 1, 0])), [by_text[1] + by_text[3], by_text[0] + by_text[2]])


def test_held_out_accuracy(spark, data):
    docs = table(spark, f"{data}/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_model_against_brute_force(spark, odd, odd_rows):
    got = langid.learn(odd, langid.crc_bucket("doc_id", 4) != 2, dims=32)
    want = {}
    for d, t, lang, *_ in odd_rows:
        if d is not None and t and lang and len(t) < 9000 and zlib.crc32(str(d).encode()) % 4 != 2:
            want[lang] = want.get(lang, 0) + plain_vector(t, 32, langid.SEED)
    assert set(got) == set(want) | {"de", "fr"} - ({"de"} if zlib.crc32(b"5") % 4 == 2 else set())
    assert np.array_equal(got["en"], want["en"])


def test_odd_rows(odd, odd_rows):
    got = langid.identify(odd).toPandas()
    assert len(got) == len(odd_rows)
    und = set(got[got.lang_pred == "und"].doc_id.dropna())
    assert und == {1, 2, 21, 24} and (got[got.lang_pred == "und"].score == 0).all()
    assert got[got.doc_id == 4].lang_pred.nunique() == 1


def test_nothing_to_learn_from(spark, odd, empty):
    assert langid.identify(empty).count() == 0
    got = langid.predict(odd, {}).toPandas()
    assert (got.lang_pred == "und").all() and (got.score == 0).all()


def test_pieces_of_long_texts_do_not_show(monkeypatch):
    texts = ["one twoΣ three ΑΣ ΑΣΑ  --  fo ur" * 9, "x" * 100, "İa b" * 20, "a", "", " ab, c " * 11, "ΑΣ" * 40]
    want = langid.bundle(texts, 64, 1)
    for size in (2, 3, 7, 10, 31):
        monkeypatch.setattr(langid, "_GROUP", size)
        assert (langid.bundle(texts, 64, 1) == want).all()
        assert (langid.bundle(texts, 64, 1, np.array([0, 1, 0, 1, 0, 1, 0])) == np.stack([want[::2].sum(0), want[1::2].sum(0)])).all()


def test_a_text_above_the_real_size():
    text = ("abc déf " * 140_000)[: langid._GROUP + 300]
    half = langid._GROUP // 2 - langid._GROUP // 2 % 8
    a, b = langid.bundle([text[:half], text[half:]], 32, 3)  # cut before a word
    assert (langid.bundle([text], 32, 3)[0] == a + b).all()
