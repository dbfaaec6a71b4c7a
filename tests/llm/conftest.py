import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns with clashing names."""
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [
        (1, "alpha beta gamma delta epsilon", "a", "x"),
        (1, "alpha beta gamma delta epsilon", "a", "x"),
        (2, None, "a", "x"),
        (3, "", None, None),
        (None, "alpha beta gamma delta epsilon", "b", "x"),
        (None, None, None, None),
        (4, " \t\n ", "b", "x"),
        (5, long, "b", "x"),
        (6, "one", "c", "x"),
        (7, "mail me: john.doe@example.com or +1 (555) 123-4567 now", "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr(
        "*", "1 as size", "2 as rank", "'q' as target", "0 as cut", "0 as fp", "0 as node", "0 as id", "0 as row", "0 as spans", "0 as score", "0 as whole", "0 as n_tokens", "0 as key"
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
