import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls, empty and odd texts, ties, repeated rows, one long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (None, "a text without an id that goes on for a while and says nothing much", "en", "s", 1),
    (3, "\n \t\n", "en", None, 3),
    (4, "one two three four five six seven eight nine ten. " * 3, "en", "s", 5),
    (4, "one two three four five six seven eight nine ten. " * 3, "en", "s", 5),
    (5, "日本語 テスト 😀 été ß <|endoftext|> don't", "xx", "s", 5),
    (6, "word " * 60_000, "en", "s", 5),
    (7, "12345 !!!", "en", "s", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with extra columns whose names operators may use inside."""
    rows = [(i, f"this is text number {i} of a small set with words enough to count as one " * 2, "en", "s", 1, 1, "k", "v", 0.5) for i in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long, key string, value string, score double")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
