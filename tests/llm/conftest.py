import pytest
from pyspark.sql import types as T

LONG = "Lorem ipsum dolor " * 20_000
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("size", T.StringType()), T.StructField("line", T.LongType()),
                     T.StructField("cls", T.StringType()), T.StructField("n", T.StringType()), T.StructField("words", T.StringType())])


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing column names."""
    base = "The quick brown fox jumps over the lazy dog near the old river bank while seven grey geese watch from far away"
    texts = [None, "", " \t\n ", "one", "two words", base, base, base + " today", base.upper(), LONG, LONG + "end", "你好 世界 \U0001f600 straße", "!!! 123 ???",
             "a b a b a b a b a b", base + "\n" + base + "\nother line of some length here", "x" * 5000]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "k", "z", 1, "c", "n", "w") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
