from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_gone", T.StringType()),
    T.StructField("_id", T.StringType()), T.StructField("score", T.StringType()), T.StructField("length", T.StringType()),
])

#: Null and empty texts, white space of all kinds, ties, and one very long text.
ODD = [
    None, "", " ", "\n\t \x0b", "a", "A.", "one two three", "one  two\nthree ", "one two three", "ones two three",
    "日本語 テキスト", "été \x1c\x85\xa0x", "<|endoftext|> it's 'll  \n x", "12 345 ½ Ⅷ", "### Assistant: </turn>\n \\", "x" * 5000 + " y",
    " ".join(f"w{i % 977}" for i in range(60_000)),
]


def rows(texts, start=0):
    return [(i, t, ("en", "fr", None)[i % 3], ("s0", None)[i % 2], 7, "g", "i", "s", "l") for i, t in enumerate(texts, start)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with extra columns whose names clash with the operators' own."""
    return lambda data: spark.createDataFrame(data if data and isinstance(data[0], tuple) else rows(data), SCHEMA)


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def real():
    import pandas as pd

    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
