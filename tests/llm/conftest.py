import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
TEXTS = [
    "The first line here\nshared tail line",
    None,
    "",
    " \t\n ",
    "  two  spaces  and\ttabs \n",
    "plain words only",
    "ÀÉ été naïve ▁marked▁ word 日本語 🙂 text",
    "a\n\n\nb\r\n",
    "plain words only",
    "12345 !!! ???",
    "one",
    LONG,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, and columns whose names operators use inside."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "key", "pos", "line", "lines", "doc", "fp", "gone", "sketch", "u", "v", "n", "kept", "words", "bucket", "_words", "host"]
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "n_chars") else T.StringType()) for c in names])
    rows = [(i * 3, text, None if i % 4 == 0 else "en", None, None, *(["x"] * (len(names) - 5))) for i, text in enumerate(TEXTS)]
    rows += [rows[5], (None, "plain words only", "en", "s", 3, *(["x"] * (len(names) - 5)))]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
