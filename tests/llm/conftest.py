import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, base string, size string, i string, block string, score string, word string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows (doc_id, text, lang, source) with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(d, t, lang, s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for d, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "the words go on and on " * 6000
    return docs_of([(1, None, None, None), (None, "a text without an id", "en", "s"), (2, "", "en", "s"), (3, long, "en", "s"), (3, long, "en", "s"), (4, " \t\n", None, "s"), (5, "token = abcdef123456", "en", None), (6, "\U0001f600 tie", "en", "t"), (7, "\U0001f600 tie", "en", "t")])
