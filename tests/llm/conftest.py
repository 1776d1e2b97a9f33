import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


#: Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and ids, odd white space and marks.
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "no id here", "en", "b", 10), (None, None, None, None, None),
    (4, words("w", 60), "en", "a", 5), (4, words("w", 60), "en", "a", 5), (4, words("v", 70), "de", "a", 5), (5, words("w", 60), "en", "c", 5),
    (6, "x " + words("w", 60) + " y", "en", "c", 7), (7, words("long", 20_000), "fr", "c", 9), (8, "rep eat " * 300, "es", "z", 1),
    (9, "a\x1cb\x85c　d\x01e <|endoftext|> ▁▁ </s> \x02\x03", "en", "a", 3), (10, "\U0001d518́ é ﬁ İ Σς", "xx", "y", 2),
    (11, "line one here\n\nline one here\nend", "en", "a", 8), (-5, words("w", 25), "en", "a", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def crowded(edge):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F
    names = ["position", "tile", "fp", "hash", "bin", "spots", "length", "rank", "n", "key", "slot", "shard", "_text", "_k1", "_turn", "kept", "nll", "low",
             "n_words", "n_entities", "text_key", "ones", "component", "group"]
    return edge.withColumns({c: F.lit("x") for c in names})
