import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, fp long, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from texts (ids from 0) or (id, text) pairs, with extra columns whose
    names the operators use themselves."""

    def make(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en" if i is None or i % 3 else None, "src", len(t) if t is not None else None, 7, 7, 0.5) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


EDGES = [None, "", " ", "a", "\n\n", "word " * 30, "word " * 30, "x" * 50_000, "é中\U0001f600 ß\x00\x85", "The end."]


@pytest.fixture(scope="session")
def edges():
    return EDGES
