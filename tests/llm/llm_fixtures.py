import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns of clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
        (2, "the Quick brown fox jumps over the lazy dog again and again.", "en", "b", 60),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "no id here mail me at a.b@example.com", "en", None, 37),
        (None, None, None, "a", None),
        (5, LONG, "en", "a", len(LONG)),
        (6, "\t\n \r", "de", "c", 4),
        (7, "naïve ▁ 日本 🙂 " * 5, "fr", "c", 60),
        (8, "one two", "en", "c", 7),
    ]
    wide = ", toxicity double, token_ids string, fp long, k long, size long, block int, codes string, taken_here long"
    return spark.createDataFrame([(*r, 0.5, "x", 1, 2, 3, 4, "y", 5) for r in rows], COLUMNS + wide)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false").cache()


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
