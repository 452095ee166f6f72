"""Every query against its SQL, at the size that is compared elsewhere too."""

import math

import duckdb
import pytest

from pluvia import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 8) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    df = catalog.QUERIES[name](spark, f"{data}/sf0.001")
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in catalog.ORACLE:
        assert rows
        return
    want = con.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
