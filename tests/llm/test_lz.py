import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvia.llm import lz
from pluvia.llm.queries import op12_lz


def phrases(text):
    """LZ78 by slices."""
    seen, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in seen:
            end += 1
        seen.append(text[at:end])
        at = end
    return seen


@settings(max_examples=80, deadline=None)
@given(st.text("abé\U0001f600 ", max_size=120))
def test_phrases(text):
    ends, *_ = lz.phrase_ends(text, {}, lz.DICTIONARY, True)
    assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == phrases(text)
    whole = lz.sketch(text, 1000)
    assert len(whole) == len(set(phrases(text)))  # no two have one hash
    assert (lz.sketch(text, 7) == whole[:7]).all()
    assert (lz.read(lz.written(whole)) == whole).all()


def similar(a, b):
    x, y = set(phrases(a)), set(phrases(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_is_exact_for_few_phrases_and_near_for_many():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for n in (0, 1, 30, 90):
        a = text(n)
        for b in (a, text(n), a[: n // 2] + text(n // 2), ""):
            assert abs(lz.likeness(lz.sketch(a, 4000), lz.sketch(b, 4000), 4000) - similar(a, b)) < 1e-12
    a = text(4000)
    b = a[:2000] + text(2000)
    assert abs(lz.likeness(lz.sketch(a), lz.sketch(b)) - similar(a, b)) < 0.15
    assert lz.likeness(lz.sketch(a), lz.sketch(a)) == 1.0


def test_long_texts(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("ab cdé") for _ in range(9000)) + "x" * 3000
    want = lz.sketch(text, 10**6)
    monkeypatch.setattr(lz, "PIECE", 777)  # pieces do not show
    assert (lz.sketch(text, 10**6) == want).all()
    monkeypatch.setattr(lz, "DICTIONARY", 50)
    found, at = set(), 0
    while at < len(text):  # a dictionary of 50 phrases at a time
        some = []
        while at < len(text) and len(some) < 50:
            end = at + 1
            while end < len(text) and text[at:end] in some:
                end += 1
            some.append(text[at:end])
            at = end
        found |= set(some)
    assert abs(len(lz.sketch(text, 10**6)) - len(found)) <= 1


@settings(max_examples=80, deadline=None)
@given(st.text("abé ", max_size=90), st.text("abé ", max_size=90))
def test_shared_beginning(text, following):
    """Going on from a shared beginning gives what parsing anew does, and parses no more than the rest."""
    edited, read = lz.spliced(text, following), []
    p = lz.parsed(text, lz._kept(text), 1000)
    assert (p.sketch == lz.sketch(text, 1000)).all()
    assert p.root is None or p.at <= lz._kept(text) == len(text) - len(text) // 2
    with pytest.MonkeyPatch.context() as m:
        whole = lz.phrase_ends
        m.setattr(lz, "phrase_ends", lambda t, *a: read.append(len(t)) or whole(t, *a))
        got = lz.sketch_from(p, edited, 1000)
    assert sum(read) == len(edited) - p.at
    assert (got == lz.sketch(edited, 1000)).all()


@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)), st.integers(1, 50))
def test_likeness_of_least_hashes(a, b, k):
    x, y = (np.array(sorted(s)[:k], np.uint32) for s in (a, b))
    union = sorted({*x.tolist(), *y.tolist()})[:k]
    want = len(set(union) & set(x.tolist()) & set(y.tolist())) / len(union) if union else 1.0
    assert lz.likeness(x, y, k) == want


def expected(rows):
    """(doc_id, text, hash of the text) in order, each with the next one."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    out = []
    for (i, text, _), (_, other, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = lz.sketch(text), lz.sketch(edited), lz.sketch(other)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.written(a), lz.written(b), lz.likeness(a, b), lz.likeness(a, c)))
    return sorted(out, key=str)


def with_hashes(df):
    return [(r[0], r[1], r[2]) for r in df.selectExpr("doc_id", "coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()]


def test_odd_rows(spark, odd):
    want = expected(with_hashes(odd))
    for size in (lz.RANGE_CHARS, 5_000):
        assert sorted(map(tuple, lz.neighbours(odd, range_chars=size).collect()), key=str) == want
    same = {r["fingerprint"] for r in lz.fingerprints(odd.where("doc_id BETWEEN 10 AND 14")).collect()}
    assert len(same) == 1


def test_few_rows(spark, empty):
    assert lz.neighbours(empty).collect() == []
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    assert [tuple(r) for r in lz.neighbours(one).collect()] == expected(with_hashes(one))
    none = spark.createDataFrame([(None, None)] * 5, "doc_id long, text string")
    assert [tuple(r) for r in lz.neighbours(none).collect()] == [(None, 0, hashlib.sha256(b"").hexdigest(), "", "", 1.0, 1.0)] * 5
    many = spark.createDataFrame([(3, "same text. " * 9)] * 400 + [(None, "other")] * 300 + [(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert sorted(map(tuple, lz.neighbours(many, range_chars=500).collect()), key=str) == expected(with_hashes(many))


def test_query(spark, data):
    root = f"{data}/sf0.01"
    got = op12_lz(spark, root).collect()
    assert sorted(map(tuple, got), key=str) == expected(with_hashes(spark.read.parquet(f"{root}/documents.parquet")))
    near, next_ = (np.array([r[c] for r in got if r["n_chars"] > 200]) for c in ("near_edited", "near_next"))
    assert near.mean() > next_.mean() + 0.1
