import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and river stone house walks slowly under bright old window morning light garden quiet road letter winter paper".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Make a documents table of (doc_id, text) pairs, with extra columns whose names operators use inside."""

    def make(pairs):
        from pyspark.sql import functions as F

        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.repartition(3).withColumns({c: F.lit("x") for c in ("id", "key", "row", "range", "n", "score", "kept", "part")})

    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space, other scripts."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Dé jà vu \x1c x"), (6, long), (7, "same text here twice now"),
        (8, "same text here twice now"), (8, "same text here twice now"), (8, "other text"), (None, "no id at all, but words"), (None, None),
        (9, "日本語 テキスト 🙂 end"), (10, "A\nA\nA\n\nB"), (11, "x " * 300), (12, "a" * 4000), (13, prose(rng, 60)),
    ]


@pytest.fixture(scope="session")
def corpus():
    """Texts of the smallest table, with its labels."""
    import duckdb

    root = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{root}/documents.parquet' order by doc_id").fetchall()
    labels = duckdb.sql(f"select doc_id, quality from '{root}/labels.parquet'").fetchall()
    return docs, labels
