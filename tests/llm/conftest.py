import pytest

from episodica.llm.shipping import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents as rows (doc_id, text) with every other column, and one whose name an operator might use itself."""

    def make(rows, lang="en", source="a"):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "y") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, anchor string"
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a null id, a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n "), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y z")]
    return [*rows, (None, None), (7, long), (8, long), (9, "ÄÖ é ü 😀 z")]
