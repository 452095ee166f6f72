import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvia.llm import warc
from pluvia.llm.sql import SQL

SCHEMA = "page_id long, url string, html string, digest string, top int"


def plain(rows):
    best = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(i, best.get(b, i))
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        revisit = best.get(b) is not None and best[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[b] if revisit else None))
    return out


def columns(df):
    return [tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def test_round_trip_of_odd_pages(spark):
    big, crlf = "<p>é</p>" * 200, ("WARC/1.1\r\n\r\n" + "x" * 30) * 40
    rows = [(1, "http://a.example/x#y", big), (9, "http://a.example/x", big), (4, None, big), (5, "http://b.example/\r\nEvil: 1", crlf), (6, "no url", None), (7, "", ""), (8, "http://c", "s" * 999), (10, "http://c", "s" * 999), (11, "http://c", "t" * 1000), (11, "http://c", "t" * 1000), (None, "http://d", big), (None, "http://d", "u" * 1200), (12, "http://e", "\r\n\r\n"), (13, "http://f", "v" * 2_000_000)]
    df = spark.createDataFrame([(*r, "d", 3) for r in rows], SCHEMA).repartition(3)
    h = warc.histories(df).cache()
    assert sorted(columns(h), key=str) == sorted(plain(rows), key=str)
    order = [(r["part"], r["place"]) for r in h.collect()]
    keys = [warc.order_of(tuple(r)[:3]) for r in sorted(h.collect(), key=lambda r: (r["part"], r["place"]))]
    assert keys == sorted(keys) and len(set(order)) == len(rows)
    assert {r["url"] for r in h.collect() if r["page_id"] == 5} == {"http://b.example/%0D%0AEvil: 1"}
    assert warc.histories(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark, data):
    from pluvia.sources.tables import table

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/sf0.01/pages.parquet'")
    assert sorted(columns(warc.histories(table(spark, f"{data}/sf0.01", "pages")))) == sorted(con.sql(SQL["op2_warc"]).fetchall())


def test_url_keys():
    assert warc.url_key("https://www.B.example.org:80/p?q#f") == "org:80,example,b)/p?q"
    assert warc.url_key("http://a.com") == "com,a)/" and warc.url_key("") == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(lists):
    got = list(warc.LoserTree([sorted(x) for x in lists], lambda v: v))
    assert got == sorted(v for x in lists for v in x)


def test_ties_go_to_the_earlier_run():
    runs = [[(1, "a"), (2, "a")], [(1, "b")], [(1, "c"), (1, "d")]]
    assert list(warc.LoserTree(runs, lambda r: r[0])) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a")]


def test_damaged_archives_are_errors():
    import pytest

    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert [b for _, _, b in warc.parse(good * 2)] == [b"ok", b"ok"]
    with pytest.raises(ValueError):
        list(warc.parse(good[:-4] + b"zz\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"x" + good))


def test_archives_end_by_bytes_and_records_are_found_by_offset(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{i}</p>" * (1 + i * 7 % 200)) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for kind, most in (("bytes", {"most_bytes": 2000}), ("records", {"most_records": 7})):
        path = f"file:{tmp_path}/{kind}"
        made = warc.write(df, path, **most)
        sizes = [(r["archive"], r["records"], r["bytes"]) for r in made.collect()]
        assert sum(r for _, r, _ in sizes) == 120 and len(sizes) > 10
        assert max(r for _, r, _ in sizes) <= 7 if kind == "records" else max(b for *_, b in sizes) < 4000
        assert all((tmp_path / kind / a).stat().st_size == b for a, _, b in sizes)
        runs = warc.read(made, path)
        for r in runs.where("page_id % 17 = 3").collect():
            h, block = warc.record_at(f"{path}/{r['archive']}", r["offset"])
            assert h["WARC-Target-URI"] == r["url"] and block.endswith(rows[r["page_id"]][2].encode())
        (tmp_path / kind / "left-behind.warc.gz").write_bytes(b"of a task that was lost")
        got = [r["page_id"] for r in sorted(warc.merged(warc.read(made, path), most=30).collect(), key=lambda r: (r["part"], r["place"]))]
        assert got == [i for h in range(3) for i in sorted((i for i in range(120) if i % 3 == h), key=lambda i: str(i))]


def test_members_across_parts_of_a_stream(monkeypatch):
    import gzip
    import io

    import pytest

    monkeypatch.setattr(warc, "_READ", 13)
    parts = [b"a" * n for n in (1, 50, 0, 3000)]
    whole = b"".join(gzip.compress(p) for p in parts)
    found = list(warc.members(io.BytesIO(whole)))
    assert [c for _, c in found] == parts
    assert all(gzip.decompress(whole[a:b]) == p for (a, _), (b, _), p in zip(found, [*found[1:], (None, b"")], parts, strict=True))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(whole[:-3])))
