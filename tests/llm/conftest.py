import pytest


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) as a table of documents, with columns that clash with none
    of the contract's but with names that operators use for their own."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), 7, "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, kept string")

    return make


@pytest.fixture
def texts(documents):
    def make(*pairs):
        return documents([(i, t, "en", "s") for i, t in pairs])

    return make
