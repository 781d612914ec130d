import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
PROSE = (
    "the harbour master wrote a letter to the owner of the small grey boat and asked him to move it before the spring tide "
    "came in because the old quay would not hold another winter of ropes pulled tight against the north wind "
)


def prose(seed: int, n: int = 60) -> str:
    words = PROSE.split()
    return " ".join(words[(seed * 7 + i * (seed % 5 + 1)) % len(words)] + ("" if i % 3 else str(seed * i % 11)) for i in range(n))


@pytest.fixture
def docs(spark):
    """Odd rows of every kind: nulls, empty and very long texts, repeated rows, ties."""
    rows = [
        (1, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n ", "fr", "b", 3),
        (6, prose(6, 40_000), "en", "a", 9), (7, "x", None, "c", 1), (7, "x", None, "c", 1), (None, prose(9), "fr", None, 1), (10, "été \U0001f600 <|endoftext|> 日本", "fr", "b", 5),
        (11, "all rights reserved. CC-BY 4.0\nall rights reserved.", "en", "c", 2), (12, "a" * 3000, "de", "c", 3000), (13, "$$$ !! ### " * 20, "de", "c", 7),
    ]
    return spark.createDataFrame(rows, DOCS)
