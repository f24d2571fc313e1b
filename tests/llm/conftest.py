"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _size int, score double, n_words string"


def _words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def words():
    return _words


@pytest.fixture(scope="session")
def odd_docs(spark):
    text = "\n".join(_words(k, 40) for k in range(5))
    near = text.replace(text.split()[50], "changed", 1)
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (3, near, "en", "b"), (4, None, "en", "b"), (5, "", None, None),
        (6, " \n\t ", "de", None), (7, "one two", "de", "c"), (8, "one two", "de", "c"), (8, "one two", "de", "c"),
        (None, text, "en", "a"), (None, None, None, None), (9, _words(99, 60_000), "en", "a"), (10, "É" * 50 + "\u00a0x  y", "fr", "é"),
        (11, _words(5, 300), "en", "a"), (12, "You are an idiot, you stupid clown! Pathetic loser trash. " * 4, "en", "b"),
    ]
    return spark.createDataFrame([(*r, 7, 7, 7, 0.5, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, (k + 1) % 2) for k in range(1, 13)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
