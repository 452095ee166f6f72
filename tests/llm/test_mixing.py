import re

import duckdb
import pytest

from pluvia.llm import mixing
from pluvia.llm.sql import SQL


def plain_targets(sizes):
    """Shares by weight, capped and shared again until none is above: sources in order, None last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(full.values())
        w = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}
        if len(full) == len(names):
            return full


def plain_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[i] += 1
    return got


def test_apportionment(spark):
    votes = [53, 24, 23, 0, 7, 7, 1000]
    for seats in (1, 5, 30, 111):
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v long, s long")
        got = {r["i"]: r["q"] for r in mixing.apportion(df, ["g"], "v", "s", "i", "q").collect()}
        assert [got[i] for i in range(len(votes))] == plain_seats(votes, seats)


def totals(df):
    return {(r["source"]): r for r in df.groupBy("source").agg({"taken": "sum", "size": "sum", "target": "max", "source_size": "max"}).collect()}


def check(docs, got, rows):
    from pyspark.sql import functions as F

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = plain_targets(sizes)
    by = got.join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n"), F.min(F.col("size") * 2 - F.col("taken")).alias("room"))
    for r in by.collect():
        assert r["target"] == pytest.approx(want[r["source"]]) and r["n"] == sizes[r["source"]] and r["room"] >= 0
        assert abs(r["taken"] - r["target"]) <= mixing.BLOCK * (mixing.SHARDS + 1) / 2


def test_query_against_sql_and_brute_force(spark, data):
    from pluvia.sources.tables import table

    docs = table(spark, f"{data}/sf0.01", "documents")
    got = mixing.mix(docs).cache()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/sf0.01/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(SQL["op4_mixing"]).fetchall())
    check(docs, got, [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_plan_is_native(spark, odd, capsys):
    mixing.mix(odd).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(odd_rows) and (got.taken <= 2 * got["size"]).all()
    assert (got[got.doc_id.isin([1, 2, 21])].taken == 0).all()
    assert got.taken.sum() == pytest.approx(1.5 * got["size"].sum(), rel=0.02)
    assert mixing.mix(empty).count() == 0 and mixing.drawn(empty).count() == 0
    nothing = spark.createDataFrame([(1, "", "en", "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0] and mixing.drawn(nothing).count() == 0
    drawn = mixing.drawn(odd)
    assert drawn.columns == odd.columns
    n = drawn.where("doc_id >= 100").groupBy("doc_id").count().toPandas()
    assert n["count"].max() <= 2
