import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, part int, th string"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang, source); columns with clashing names come along."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "a")[len(r) - 2 :]) if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text or ""), True, "x", 7, "y"))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def by_id():
    return lambda df: {r[0]: r for r in df.collect()}
