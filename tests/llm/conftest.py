import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A session whose shared folder is a folder of the test run."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    return spark


#: Rows with nulls, empty, blank and short texts, repeated rows and ids, and columns whose names clash.
ODD = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
       (2, None, None, None), (3, "", "en", "b"), (4, " \t\n ", None, "b"), (5, "one", "en", None), (None, "the null id row has words of its own here", "en", "a"),
       (None, None, None, None), (6, "Ünïcödé wörds € and 12 34", "de", "c"), (7, "x " * 3000, "en", "c"), (8, "12345 !!! 678", "en", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(shared):
    from pyspark.sql import functions as F
    docs = shared.createDataFrame(ODD, SCHEMA)
    for name in ("score", "SIZE", "Spans", "n_words", "copies", "print", "host", "quality", "found", "kept", "Target"):
        docs = docs.withColumn(name, F.lit("own"))
    return docs


@pytest.fixture(scope="session")
def empty(shared):
    return shared.createDataFrame([], SCHEMA)
