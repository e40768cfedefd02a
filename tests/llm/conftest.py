import pytest


@pytest.fixture
def docs(spark):
    """A table of documents with an extra column, from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_hit string")

    return make


#: Rows every operator must bear: nulls, empty and blank texts, repeated rows and ids, an odd alphabet, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id"), (None, None), (4, "twice"), (4, "twice"), (4, "another text"), (5, "İstanbul Kelvin K ß é 中文 \U0001f600"), (6, "word " * 30000)]
