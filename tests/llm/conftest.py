import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases: null, empty, white space, repeated rows, long, extra columns with names that operators use."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
        (2, "The quick brown fox  jumps over the lazy dog near the river bank today", "a"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n", "b"),
        (6, "word " * 5000, "b"),
        (7, "word " * 5000, "b"),
        (7, "word " * 5000, "b"),
        (8, "tiny", None),
        (None, "tiny", "c"),
        (9, "The quick brown fox jumps over the lazy dog near the river bank tonight", "a"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return table.selectExpr("*", "'x' as score", "1 as row", "'y' as items", "2 as n", "'z' as digest", "cast(length(text) as long) as n_chars", "'en' as lang")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
