import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                    # names that operators use themselves
                    T.StructField("component_id", T.StringType()), T.StructField("mix_slot", T.StringType()), T.StructField("keep", T.StringType()),
                    T.StructField("block", T.StringType()), T.StructField("h", T.StringType()), T.StructField("row", T.StringType())])
WORDS = [f"word{i}" for i in range(60)]
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
#: Nulls in every column, empty, blank and long texts, copies, repeated rows and ids.
ROWS = [(1, " ".join(WORDS), "en", "a"), (2, " ".join(WORDS), "en", "a"), (3, " ".join([*WORDS[:59], "other"]), "en", "b"), (4, None, None, None),
        (5, "", "de", ""), (6, " \t\n", None, "a"), (7, "one two", "en", "a"), (7, "one two", "en", "a"), (None, "no id here at all, five words", "en", "b"),
        (8, LONG, "en", "b"), (9, LONG + " tail", "en", None), (10, "Ünï çödé " * 20, "fr", "c"), (11, "x", None, "c"), (12, "ONE TWO", "en", "c")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, k, s, None if t is None else len(t), *["extra"] * 6) for i, t, k, s in ROWS], DOC)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC)
