import pytest

LONG = "Lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, names that operators use inside."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 48, 7, "x"),
        (2, "One TWO three four five six seven eight nine ten", "en", "a", 48, 7, "x"),
        (2, "One TWO three four five six seven eight nine ten", "en", "a", 48, 7, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 7, "x"),
        (5, " \t\n\r\x0b\x0c ", "en", "b", 7, 7, None),
        (6, LONG, "la", "c", len(LONG), 7, "x"),
        (None, "a text without an id", "en", "a", 20, 7, "x"),
        (8, "kurz und gut \U0001f600 <|im_end|>", "de", "", 20, 7, "x"),
        (9, "kurz und gut \U0001f600 <|im_end|>", "de", None, 20, 7, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, shard string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
