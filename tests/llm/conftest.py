import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept string, score string, found string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) rows, with more columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", "d") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in each column, empty and long texts, repeated rows, white space only."""
    long = " ".join(f"word{n % 700} and" for n in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (5, long), (6, "one"), (6, "one"), (None, "no id"), (7, "日本語 é ñ \x00 😀"), (8, "x" * 50_000)]
    return docs_of(rows)
