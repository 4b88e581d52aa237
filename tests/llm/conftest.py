import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts; ids 0, 1, ..."""

    def make(texts, **cols):
        rows = [(i, t, cols.get("lang", [None] * len(texts))[i], cols.get("source", [None] * len(texts))[i], len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


#: Nulls, blanks, one word, ties, repeated rows, long and odd texts.
ODD = [None, "", " \n\t ", "one", "a b c d", "Ümläut ÀÉ 日本 text", "x" * 5000, "word " * 4000, "a b c d", "tab\tand\x0bvt\x1cfs", "last\n", "«»…", "é" * 150]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
