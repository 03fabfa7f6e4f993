"""Awkward documents that every operator must take."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, chunk string, fp string"


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def awkward():
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = words(5, 30_000)
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, "a", None),
        (3, "one two three", "en", None, 13),
        (4, words(1, 60), "en", "b", None),
        (5, words(1, 60), "en", "b", None),
        (5, words(1, 60), "en", "b", None),
        (6, words(1, 59) + " x", "de", "b", None),
        (None, words(2, 40), "de", "c", None),
        (None, None, None, None, None),
        (7, "   \t\n ", "fr", "c", 6),
        (8, "été déjà 日本語 😀 naïve", "fr", "c", None),
        (9, "12345 !!! ###", "es", "c", None),
        (10, long, "es", "c", len(long)),
        (11, "<|endoftext|> hello <|endoftext|>", "en", "d", None),
    ]
    return [(*r, 0.5, "x", "y") for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
