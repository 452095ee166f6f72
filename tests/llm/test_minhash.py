import random

import numpy as np
import pytest

from pluvia.llm import minhash, wordscan


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def plain(rows, link=85):
    """component of each row by comparing all pairs of sets."""
    sets = [shingle_set(t) for _, t in rows]
    comp = [d for d, _ in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= link * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows, n=4, link=85):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, link=link).collect()), key=str)
    assert got == sorted(plain(rows, link), key=str)


def text(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def test_words_are_split_and_counted():
    rng = random.Random(1)
    alphabet = "ab\x1c\xa0é \t\n\x0b\x0c\r 　A"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))).encode() for _ in range(300)]
    w = wordscan.hash_words(texts)
    assert w.counts.tolist() == [len(t.split()) for t in texts]
    assert len(np.unique(w.hashes)) == len({x for t in texts for x in t.split()})
    v, n = wordscan.shingles(w.hashes, w.counts)
    assert n.tolist() == [len({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}) if t.split() else 0 for t in texts]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    t = text(rng, 3000).encode()
    whole = wordscan.hash_words([t]).hashes
    monkeypatch.setattr(wordscan, "PIECE", 997)
    assert np.array_equal(wordscan.hash_words([b"x y", t, b"z"]).hashes[2:-1], whole)
    assert b"".join(wordscan.split_long(t, 997)) == t


def test_sub_keys_use_a_square_root_of_the_hashes():
    v = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert [minhash.collections_for(link) for link in (85, 80)] == [8, 11]
    sub = minhash.sub_keys(v, np.array([20, 19]), 8)
    assert sub.shape == (2, 16) and minhash.table_keys(sub).shape == (2, 64)
    assert len(np.unique(minhash.table_keys(sub))) == 128


@pytest.mark.parametrize("block", [512, 3])
def test_groups_of_copies(spark, monkeypatch, block):
    """A base with copies that are near it but not near one another, exact copies, chains, and shared passages."""
    monkeypatch.setattr(minhash.links, "__defaults__", (block,))
    rng = random.Random(3)
    rows, n = [], 0
    base = text(rng, 400).split()
    passage = text(rng, 60)
    for i in range(25):
        c = list(base)
        for k in rng.sample(range(400), 6):
            c[k] = f"v{i}"
        rows.append((n, " ".join(c)))
        n += 1
    rows.append((n + 1000, " ".join(base)))
    for i in range(30):
        rows.append((n + i, f"{text(rng, 30 + i)} {passage} {text(rng, 30)}"))
    rows += [(2000 + i, rows[3][1]) for i in range(9)] + [(3000 + i, "Just the SAME words here") for i in range(4)]
    chain = text(rng, 200).split()
    for i in range(12):
        chain = [*chain[3:], *text(rng, 3).split()]
        rows.append((4000 + i, " ".join(chain)))
    check(spark, rows)


def test_odd_rows(spark, odd, odd_rows, empty):
    check(spark, [(r[0], r[1]) for r in odd_rows])
    got = minhash.near_duplicates(odd).toPandas()
    assert len(got) == len(odd_rows)
    assert (got[got.doc_id == 5].n_shingles == 1).all() and got[got.doc_id == 4].kept.all()
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(got[got.kept].doc_id)) and ids.count(None) == 2
    assert sorted(map(str, kept.collect())) == sorted(map(str, minhash.deduplicated(odd.repartition(5)).collect()))
    assert minhash.deduplicated(empty).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """Unrelated texts with one doc_id are two documents; copies with one doc_id are one."""
    rng = random.Random(5)
    a, b, c, d = (text(rng, 80) for _ in range(4))
    rows = [(4, a), (4, b), (2, a + " end"), (9, b + " end"), (9, c), (9, c), (7, d), (7, d + " end"), (8, ""), (8, None), (8, d + " last"), (None, c), (None, None)]
    check(spark, rows)
    docs = [(*r, f"s{i}") for i, r in enumerate(rows)]
    for n in (1, 5):
        df = spark.createDataFrame(docs[::-1], "doc_id long, text string, source string").repartition(n)
        got = [tuple(r) for r in minhash.deduplicated(df).select("doc_id", "text", "source").collect()]
        assert sorted(((i, t) for i, t, _ in got if i is not None), key=str) == sorted([(2, a + " end"), (4, b), (7, d), (8, None), (9, c)], key=str)
        assert [i for i, _, _ in got].count(None) == 2
        ours = {s for i, _, s in got if i == 9}
        assert n == 1 or ours == first
        first = ours


def near(text, n, tag):
    """The text with its last n words replaced."""
    return " ".join([*text.split()[:-n], *(f"{tag}{i}" for i in range(n))])


@pytest.mark.parametrize("link", [85, 80])
def test_an_id_with_two_texts_links_neither(spark, link):
    """Rows with one doc_id and different texts, one of them a copy of another document's."""
    rng = random.Random(6)
    x, unique = text(rng, 100), text(rng, 90)
    y = near(x, 9, "q")  # 87 of 105 shingles: 0.829
    rows = [(3, y), (5, y), (5, x), (1, unique + " a"), (2, unique + " a"), (2, text(rng, 50)), (7, x)]
    check(spark, rows, link=link)
    check(spark, [r for r in rows if r != (5, y)], link=link)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _id int")
    kept = {r["_id"] for r in minhash.deduplicated(docs, link=link).collect()}
    assert kept == ({0, 2, 3, 5} if link == 85 else {0, 3, 5})


def test_rows_equal_in_every_column(spark):
    rng = random.Random(7)
    a = text(rng, 60)
    docs = spark.createDataFrame([(1, a, "s")] * 6 + [(2, a, "s")] * 3 + [(3, "", "s")] * 2, "doc_id long, text string, source string").repartition(3)
    assert sorted(map(tuple, minhash.deduplicated(docs).collect())) == [(1, a, "s"), (3, "", "s")]
