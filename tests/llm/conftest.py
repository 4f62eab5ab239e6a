import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, matches string, block string, row int, `odd name` double"


def frame(spark, rows):
    """documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, lang, src, None if t is None else len(t), "x", "y", 7, 1.5) for d, t, lang, src in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, blank texts, non-ASCII."""
    long = words(30_000, 1)
    copy = words(80, 2)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r", "en", "a"), (4, "... 12 !!", "en", None), (5, long, "en", "a"),
        (6, copy, "en", "a"), (7, copy + " ", "en", "a"), (8, copy.replace(" ", "\n", 3), "fr", "b"), (9, copy + " w1 w2", "en", "a"), (6, copy, "en", "a"),
        (None, copy, "en", "a"), (None, None, None, "b"), (10, "É" * 300 + " ß \U0001f600 x", "de", "b"), (11, "one two three", "en", "a"), (12, "one two three", "en", "b"),
        (13, "ONE two\nthree", "en", "b"), (14, "x" * 5000, "en", "b"), (15, "a\n" * 40, "en", "b"), (16, "a\nb\nc\nd\ne\na\nb\nc", "fr", "b"), (17, long + " tail", "en", "a"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
