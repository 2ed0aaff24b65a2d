import pytest

DATA = "/root/testdata/sf0.001"
NASTY = [None, "", " ", "\n\t", "a", "é" * 3, "word " * 3000, "x" * 30000, "The same text twice over, with words enough to count.", "The same text twice over, with words enough to count."]


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names operators use themselves."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "k", 1, "f") for i, t in pairs], "doc_id long, text string, k string, start int, found string")

    return make


@pytest.fixture
def nasty(docs):
    return docs([*enumerate(NASTY), (None, "no id"), (None, None), (3, "an id again"), (3, "an id again")])
