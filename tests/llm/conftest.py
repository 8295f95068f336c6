import pytest
from pyspark.sql import types as T

# Extra columns carry names that the operators use inside.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
                     T.StructField("h", T.LongType()), T.StructField("size", T.StringType()),
                     T.StructField("shard", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) rows."""
    from maskfold.session import ship_package
    ship_package(spark)

    def make(rows):
        rows = [(i, t, "en", s, None, "x", 1, "y", "z", None) for i, t, s in rows]
        return spark.createDataFrame(rows, DOCS).repartition(3)
    return make


EDGE = [
    (1, "One two three four five six seven\nshared line of text\nend", "a"),
    (2, "one TWO three four five six seven\n  Shared LINE of text \nother", "a"),
    (3, "", "a"), (4, None, None), (5, " \t\n", "b"), (6, "x", "b"), (7, "x ", "b"), (8, " x", None),
    (9, "w " * 30000, "b"), (10, "shared line of text\nshared line of text", "c"), (11, "a\n\nb\r\n c", "c"),
    (12, "One two three four five six seven\nshared line of text\nend", None),
    (None, "null id shared line of text\nshared line of text", "a"),
    (13, "repeated row with some words in it", "d"), (13, "repeated row with some words in it", "d"),
    (14, "été ÉTÉ Straße x " * 5, "d"), (15, "tail  double   spaces \n\n end ", "d"),
]


@pytest.fixture(scope="session")
def edge(make_docs):
    return EDGE, make_docs(EDGE)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
