import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (None, word, None, None), (4, word, "en", "a"), (4, word, "en", "a"),
        (5, "!!! ... 123", "en", None), (6, " ".join(f"w{i % 977}" for i in range(40_000)), "en", "b"), (None, None, None, None),
        (8, "ein zwei drei vier fünf sechs", "de", "b"), (9, "one", "en", "b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    clash = ["key", "id", "row", "size", "n", "node", "digest", "place", "shard", "slot", "copies", "blob", "fp", "word", "n_chars"]
    return docs.withColumns({c: F.lit(7).cast("bigint") for c in clash})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")
