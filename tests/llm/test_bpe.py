import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvia.llm import bpe
from pluvia.llm.queries import tokenizer

TOKENIZER = tokenizer()
tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.vocabulary(TOKENIZER))


def same(ours, theirs, texts):
    got = ours.encode(texts)
    for text, g, w in zip(texts, got, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert (g[0].decode(), g[1]) == (" ".join(map(str, w.ids)), len(w.ids)), text[:80]
        assert g[2].decode() == theirs.decode(w.ids, skip_special_tokens=False) == bpe.decode(TOKENIZER, w.ids)


def test_texts_of_every_kind(ours, theirs):
    same(ours, theirs, ["", " ", "a", "<|endoftext|> hi<|startoftext|>", "ΑΣ Σ ΑΣΑ", "a" * 300, "ab" * 200 + " it's I'LL don't", "\x1cfoo\x1dbar \x85 x", "ŉ İstanbul ǅ ﬁ", "é ̈́", "a\x00b", "aaaa" * 40 + "!!!!" * 30, "x <| y", "12345 ½ Ⅷ", "日本語 テスト", "\U0001f600\U0001f601"])


def test_code_points_of_all_planes(ours, theirs):
    same(ours, theirs, [f"a{chr(c)}b {chr(c)}" for c in range(0, 0x110000, 13) if not 0xD800 <= c < 0xE000])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(bpe.Encoder(bpe.vocabulary(TOKENIZER)), tokenizers.Tokenizer.from_file(TOKENIZER), [text])


def test_long_words_and_a_small_cache(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    texts = [f"word{i} thing{i} " * 3 + "z" * (40 + i) for i in range(60)]
    same(bpe.Encoder(bpe.vocabulary(TOKENIZER)), theirs, texts)


def test_query(spark, data, theirs):
    from pluvia.sources.tables import table

    docs = table(spark, f"{data}/sf0.01", "documents")
    got = {r["doc_id"]: r for r in bpe.digests(docs, TOKENIZER).collect()}
    for d in docs.collect():
        ids = theirs.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, odd_rows, empty):
    got = bpe.digests(odd, TOKENIZER).collect()
    assert len(got) == len(odd_rows) and bpe.digests(empty, TOKENIZER).count() == 0
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if r["doc_id"] in (1, 2, 21))
    ids = {r["doc_id"]: r["ids"] for r in bpe.tokens(odd, TOKENIZER).collect()}
    assert len(ids[3]) == 1 and ids[1] == []
