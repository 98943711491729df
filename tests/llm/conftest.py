import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls, repeated rows, ties, an empty and a very long text, and columns named like inner ones."""
    long = "word " * 60_000
    rows = [
        (1, "same text here", "en", "a", 14, 1, "x"), (2, "same text here", "en", "a", 14, 1, "x"), (2, "same text here", "en", "a", 14, 1, "x"), (3, None, None, None, None, None, None),
        (None, "same text here", None, "b", 14, 2, None), (None, None, None, None, None, None, None), (4, "", "en", "b", 0, 1, "y"), (5, "", "en", None, 0, 1, "y"), (6, long, "en", "a", len(long), 3, "z"),
        (7, "other words\nof a kind", "de", "b", 21, 3, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest long, rate string").withColumnRenamed("digest", "_tw_digest")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
