import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    rows = [(1, "The cat sat.", "a"), (2, None, "a"), (3, "", None), (4, "the  cat\tsat .", "b"), (5, "thecatsat.", "b"), (5, "thecatsat.", "b"), (None, "null id", "c")]
    rows += [(6, "long " * 9000 + "end", "d"), (7, "\x0b\x0c \r\n", "d"), (8, "Ünï ço∂e 🎉 <|endoftext|> it's", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "'x' as id", "'y' as row", "doc_id as window")
