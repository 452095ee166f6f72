import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, kept int, `rank` int, t binary, _id long, _d string, _times int, _copy int, _row string, _key int, h long, n int, root long, component_id long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in any column, empty and very long texts, ties, repeats, and columns with clashing names."""
    rng = random.Random(4)
    long = words(rng, 120_000)  # more than half a megabyte
    no_space = "x" * 1_500_000
    same = words(rng, 40)
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (3, "a", None, "b"), (4, long, "fr", None), (4, long, "fr", None), (5, no_space, "de", "b"), (None, "one two three four five six", "en", "a"), (None, None, None, None)]
    rows += [(10 + i, same, "en", "c") for i in range(5)] + [(20, same + " end", "en", "c"), (21, "  \t\n ", "en", "c"), (22, "été à la plage " * 20, "fr", "d"), (23, same.upper(), "en", "d"), (24, "9 8 7 !!", "en", "d")]
    rows += [(100 + i, words(rng, rng.randint(1, 90)), rng.choice(["en", "fr"]), rng.choice("abcd")) for i in range(40)]
    return [(*r, None if i % 3 else 5, 0.5, "x", 1, 2, b"t", i, None, 3, 4, "r", 5, None, 1, 2, 3) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
