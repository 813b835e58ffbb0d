import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today, said Ann.", "en", "a", 10, "x"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today, said Ann.", "en", "a", 10, "x"),
    (3, None, "en", None, None, "y"),
    (4, "", None, "b", 0, None),
    (5, "word", "de", "b", 4, "z"),
    (6, "word", "de", "b", 4, "z"),
    (6, "word", "de", "b", 4, "z"),
    (None, "no identifier but words enough for a shingle here", "en", "c", 1, "q"),
    (7, "mail me at jo@ex.org, call +49 (30) 1234-5678 or 10.0.0.1; card 4111 1111 1111 1111 \U0001F600", "en", "c", 1, "q"),
    (8, "été à la plage   ünïcode ｊｏ＠ｅｘ．ｃｏｍ " + "x" * 3000, "fr", "c", 1, "q"),
    (9, "alpha beta " * 6000, "en", "a", 1, "q"),
    (10, "\t\n  \r", "en", "a", 1, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, block string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators use themselves."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
