import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvia.llm import repair
from pluvia.llm.queries import op11_repair
from pluvia.llm.sql import SQL

GOOD = re.compile("(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}


def every_edit(rows):
    """All (cost, audit, turns) of rows (role, text, fault), with two inserted turns at most between rows."""
    out = [(0, "", ())]
    for row in [*rows, None]:
        out += [(c + 2, a + "I", t + ((r, ""),)) for c, a, t in out for r in ROLES.values()]
        out += [(c + 2, a + "I", t + ((r, ""),)) for c, a, t in out if a.endswith("I") for r in ROLES.values()]
        if row is None:
            break
        role, text, fault = row
        new = [(c + 3, a + "D", t) for c, a, t in out]
        if fault not in ("blank", "duplicate"):
            more = fault == "cut"
            new += [(c + more, a + "K", t + ((role, text),)) for c, a, t in out]
            new += [(c + 2 + more, a + "R", t + ((r, text),)) for c, a, t in out for r in ROLES.values()]
        out = new
    return out


def brute(rows):
    found = [x for x in every_edit(rows) if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in x[2]))]
    least = min(x[:2] for x in found)
    turns = {x[2] for x in found if x[:2] == least}
    assert len(turns) == 1  # an audit settles the turns
    return *least, turns.pop()


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "cut" if last not in ".!?" else "fine")
        seen.add((role, text))
    return out


CODE = {"fine": repair.FINE, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "cut": repair.CUT}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["fine", "fine", "blank", "duplicate", "cut"])), max_size=3))
def test_search_against_all_edits(rows):
    cost, audit, turns = brute([(r, f"t{i}", f) for i, (r, f) in enumerate(rows)])
    assert repair.cheapest([r[:1] for r, _ in rows], bytes(CODE[f] for _, f in rows)) == (cost, audit)
    assert tuple(repair.edited(audit, iter([(r, f"t{i}") for i, (r, _) in enumerate(rows)]))) == turns


def layered(initials, faulty):
    """The same by labels from turn to turn."""
    none = (10**9, "")
    lab = {"": (0, ""), "s": none, "u": none, "a": none}

    def closed(lab):
        u = min(lab["u"], *((c + 2, x + "I") for c, x in (lab[""], lab["s"], lab["a"])))
        return {**lab, "u": u, "a": min(lab["a"], (u[0] + 2, u[1] + "I"))}

    for r, f in zip(initials, faulty, strict=True):
        lab = closed(lab)
        new = {q: (c + 3, x + "D") for q, (c, x) in lab.items()}
        if f not in (repair.BLANK, repair.DUPLICATE):
            t = f == repair.CUT
            for q, (c, x) in lab.items():
                to = "a" if q == "u" else "u"
                new[to] = min(new[to], (c + 2 + t, x + "R"))
                if r == to or (r == "s" and q == ""):
                    new[r] = min(new[r], (c + t, x + "K"))
        lab = new
    return min(lab[""], closed(lab)["a"])


def test_long_conversations_against_labels():
    rng = random.Random(1)
    for n in (60, 200, 700):
        for weights in ((1, 8, 8, 1), (0, 1, 0, 0), (1, 1, 1, 1)):
            initials = rng.choices("suax", weights, k=n)
            bad = [rng.choices(range(4), (6, 1, 1, 2))[0] for _ in range(n)]
            assert repair.cheapest(initials, bytes(bad)) == layered(initials, bad)


@settings(max_examples=200, deadline=None)
@given(st.text("DIKR", max_size=300), st.text("DIKR", max_size=300), st.integers(0, 280))
def test_trails_are_ordered_as_their_texts(a, b, shared):
    root = repair.Trail.empty()
    b = a[:shared] + b

    def grown(text):
        t = root
        for ch in text:
            t = t.then(ch)
        return t

    x, y = grown(a), grown(b)
    assert (x.text(), y.text()) == (a, b)
    assert (x < y, y < x) == (a < b, b < a)


def expected(rows):
    """op11's rows of (conv_id, turn, role, text), in plain Python."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = set()
    for conv, held in convs.items():
        mark = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), mark(x[1], x[2])))
        plain = [(r, t) for _, r, t in held]
        bad = faults(plain)
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
        cost, audit = layered([r[:1] for r, _ in plain], [CODE[f] for f in bad])
        text = "\n".join(f"{r}:{t}" for r, t in repair.edited(audit, iter(plain)))
        out.add((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("cut"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


SCHEMA = "text string, role string, extra int, conv_id long, turn long, N string, head string, place int, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(t, r, 1, c, n, "n", "h", 2, None) for c, n, r, t in rows], SCHEMA).repartition(5)


def test_odd_rows(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " \n", "yes.", "no", "Why?  ", "été!\t", "x" * 90_000 + ".", "same."])
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice([None, "", "system", "user", "assistant", "tool", "us"]), text()) for _ in range(300)]
    rows += [(50, 0, None, None), (51, None, "user", "one."), (51, None, "user", "one.")]
    lost = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "gone.")] + [(60, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(900)]
    got = repair.digests(repair.damaged(frame(spark, rows).drop("N"))).collect()
    assert len(got) == len({r[0] for r in got})
    assert {tuple(r) for r in got} == expected(rows)
    assert [tuple(r)[1:] for r in got if r[0] == lost] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_turns_and_empty_tables(spark):
    rows = [("x", 1, "assistant", "b."), ("x", 0, "user", "a"), ("x", 2, "assistant", "c."), ("y", 0, "assistant", "d.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = repair.audits(df)
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in found.collect()} == {("x", 3, "KKIK"), ("y", 2, "IK")}
    got = {(r["conv_id"], r["place"], r["role"], r["text"]) for r in repair.repaired(df, found).collect()}
    assert got == {("x", 0, "user", "a"), ("x", 1, "assistant", "b."), ("x", 2, "user", ""), ("x", 3, "assistant", "c."), ("y", 0, "user", ""), ("y", 1, "assistant", "d.")}
    assert repair.digests(repair.damaged(df.limit(0))).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, data, size):
    got = op11_repair(spark, f"{data}/{size}").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/{size}/conversations.parquet'")
    want = con.sql(SQL["op11_repair"])
    assert want.columns == list(got[0].asDict())
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert {tuple(r) for r in got} == expected(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
