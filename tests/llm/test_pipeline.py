import collections
import hashlib

import pytest

import corpus_pipeline
from pluvia.llm import bpe, mixing, quality, secrets
from pluvia.llm.common import crc_bucket
from pluvia.sources.tables import table

from .test_minhash import plain as plain_near


@pytest.fixture(scope="module")
def stages(spark, data):
    """Rows after each stage, each written and read again as a cluster would."""
    root = f"{data}/sf0.001"
    docs, out = table(spark, root, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, root), "s")
        out.append(docs)
    return root, out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_against_brute_force(spark, stages):
    root, out = stages
    docs = table(spark, root, "documents")
    model = quality.learn(docs, table(spark, root, "labels"), crc_bucket("doc_id", 5) != 0)
    start = rows(docs)
    keep = {r["doc_id"] for r in start if quality.scores([r["text"].encode()], model)[0] >= 0.3}
    assert {r["doc_id"] for r in rows(out[0])} == keep and 0 < len(keep) < len(start)
    first = {d for d, _, c in plain_near([(r["doc_id"], r["text"]) for r in rows(out[0])], corpus_pipeline.NEAR) if d == c}
    assert {r["doc_id"] for r in rows(out[1])} == first
    before = {r["doc_id"]: r for r in rows(out[1])}
    for r in rows(out[2]):
        b = before[r["doc_id"]]
        assert r["text"] == secrets.redact(b["text"].encode()).decode() and r["n_chars"] == len(r["text"])
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in b.items() if k not in ("text", "n_chars")}
        assert secrets.spans(r["text"].encode()) == []
    taken = {r["doc_id"]: r for r in mixing.mix(out[2]).collect()}
    times = collections.Counter(r["doc_id"] for r in rows(out[3]))
    assert all(times[d] == int((r["taken"] / r["size"] if r["size"] else 0) + 0.5) for d, r in taken.items())
    assert [d.columns for d in out[:4]] == [docs.columns] * 4


def test_last_stage_and_run(spark, stages):
    root, out = stages
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(corpus_pipeline.tokenizer())
    text = {r["doc_id"]: r["text"] for r in rows(out[3])}
    for r in rows(out[4]):
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    ran = corpus_pipeline.run(spark, root)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, out[4].collect()))
    assert bpe.digests(out[3], corpus_pipeline.tokenizer()).count() == out[3].count()


def test_stages_take_odd_and_empty_tables(spark, data, odd, empty):
    root = f"{data}/sf0.001"
    for docs, least in ((odd, 1), (empty, 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.stored(stage(spark, docs, root), "s")
            assert k == 4 or out.columns == docs.columns
            assert out.count() >= least
            docs = out
