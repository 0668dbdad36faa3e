import pytest

LONG = "Alpha beta gamma delta. " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and columns of clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog by the river bank.", "en", "a", 7),
        (2, "The quick brown fox jumps over the lazy dog by the river bank.", "en", "a", 7),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, LONG, "en", "b", 1),
        (6, "12345 67890 !!!", None, None, 2),
        (7, "der schnelle braune fuchs springt ueber den faulen hund am fluss", "de", "c", 3),
        (7, "der schnelle braune fuchs springt ueber den faulen hund am fluss", "de", "c", 3),
        (8, "été \U0001f600 naïve \n\n x", "fr", "c", 4),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size bigint").selectExpr(
        "*", "'x' as component_id", "1 as copies", "2 as key", "3 as score", "'y' as word", "0 as n_chars"
    )


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
