import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, and repeated rows."""
    long = "the quick brown fox jumps over the lazy dog " * 4000
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (4, long, "en", "a", len(long)),
            (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14), (None, "no id at all", None, None, None),
            (6, "1234 5678 !!!", "en", "a", 13), (7, "x", "en", "a", 1), (8, "same text here", "en", "b", 14)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
