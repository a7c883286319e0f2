import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (id, text) or whole rows."""

    def make(rows, schema=DOC):
        full = [r if len(r) > 2 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return docs_of([
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "", None, "a", 0), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7),
        (None, "only words here", "de", "b", 15), (5, " \n\t ", "en", "b", 4), (6, "*** %%%", "en", "b", 7), (7, "word " * 30_000, "en", "a", 150_000), (4, "another text of four", "en", "a", 20),
        (8, "x" * 200_000, "fr", "c", 200_000), (9, "日本語 のテキスト — “ok”", "ja", "c", 15),
    ])
