import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (ids by position) or (doc_id, text) pairs."""
    def make(rows, schema=DOC):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    return make


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
