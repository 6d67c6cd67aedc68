import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, "en", "src", len(t or ""), "clash", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int")

    return make


LONG = "ab " * 40_000 + "x" * 3_000 + " 1.2.3.4 " + "\n" * 50 + "é😀 " * 2_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here for all of us"), (6, "same text here for all of us"), (6, "same text here for all of us"), (None, "a row without an id"), (7, "one")]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
