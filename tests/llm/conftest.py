import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with odd rows: null, empty and blank texts, repeats, null ids and sources, and columns with clashing names."""

    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", None, None, 4),
    (4, "the same words stand here twice over", "en", "b", 36),
    (4, "the same words stand here twice over", "en", "b", 36),
    (5, "the same words stand here twice over", "en", None, 36),
    (None, "a row without an id and with other words", "de", "c", 40),
    (6, "x", "de", "c", 1),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
