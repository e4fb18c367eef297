import random

import pytest

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "é", "ß")) for _ in range(rng.randint(1, 3)))
    some = [" ".join(word() for _ in range(60)) for _ in range(6)]
    long = " ".join(word() for _ in range(30_000))
    rows = [
        (1, some[0], "en", "a"), (2, some[0], "en", "a"), (3, some[0] + " more", None, "b"), (4, None, "en", "b"), (5, "", "de", None),
        (6, " \n\t ", "de", None), (7, "word", "fr", "c"), (8, "A B c", "fr", "c"), (None, some[1], "en", "a"), (None, None, None, None),
        (9, some[2], "de", "a"), (9, some[2], "de", "a"), (10, some[2], "de", "a"), (11, long, "en", "b"), (12, long + " tail", "en", "b"),
        (13, "1234 5678 !!", "en", "a"), (14, some[3] + " MIT License, " + some[4], "fr", "c"), (15, "x" * 5000, None, "a"), (16, "ab " * 400, "de", "b"),
        (17, "\x00 nul \x01 \x7f É", "fr", "c"), (18, some[5], "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "n", "h", "part", "bucket", "window", "words", "size", "shard", "slot", "label", "train", "bench_hits", "lang_pred", "quality_score", "repeat_spans", "lic_words", "mix_target", "spans", "k1", "draw", "row", "doc", "doc_order", "_doc", "_key", "_kept", "_one", "_part", "_salt", "h1", "h2", "node", "class", "cell", "_good"]
    return odd.withColumns({n: F.lit("own") for n in names})
