import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, source]) rows, with further columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "k", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
