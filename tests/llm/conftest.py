import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))

#: Nulls in any column, empty and very long texts, repeated rows, equal texts, odd characters.
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, "  \n\t ", "de", None, None),
    (5, "It was the end of the day and the sea was still.", "en", "a", 48),
    (6, "It was the end of the day and the sea was still.", "en", "b", 48),
    (7, "%%% !!! 123", "fr", "b", 11),
    (8, "日本語のテキスト 🙂 é́ ﬁn", None, "c", 17),
    (9, "<|endoftext|> <0x0A> x", "en", "c", 22),
    (9, "<|endoftext|> <0x0A> x", "en", "c", 22),
    (None, "no id at all here", "en", "c", 17),
    (10, "a" * 3000, "en", "c", 3000),
]

#: Names that operators use inside.
CLASHING = ("ids", "n", "position", "part", "key", "bands", "id", "bucket", "class", "lang_pred", "score", "words", "range", "turn", "hashes", "html", "path")


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
