import pytest

BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns that clash with outputs."""
    from pyspark.sql import functions as F

    long = "lorem ipsum dolor " * 30_000
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (None, "one two three four five six", "en", "a", 1), (4, long, "en", "a", len(long)),
        (5, "same text here", "en", "b", 14), (5, "same text here", "en", "b", 14), (6, "same text here", "en", "b", 14), (5, "another text of the same id", "en", "b", 1), (BIG, "the id beside a null is larger than a double can hold", "en", "b", 1), (7, "é ß 你好 😀 \x00 \\ ' \"", "xx", "c", 1), (None, None, None, None, None),
    ]
    clash = ("id", "size", "key", "t", "w", "h", "n", "p", "k", "r", "set", "rep", "comp", "bucket", "tag", "prior", "fit", "distance", "kept", "shard", "slot", "n_words", "target", "part", "row", "hash", "copy", "copies", "head", "nth", "doc", "crc", "block", "run", "i", "_id", "_t", "_h", "_n", "_c", "_k0", "_d", "_f", "_g", "_w", "_l", "_s", "_p", "_")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
