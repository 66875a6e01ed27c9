import pytest

#: Nulls, empty and blank texts, a long one, ties, repeated rows: (doc_id, text)
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three four five six"), (6, "one two three  four five six"),
    (7, "a b c\nd e f\ng h i\nj k l"), (8, "x\na b c\nd e f\ng h i\ny"), (9, "word " * 30000), (None, "no id"), (10, "<|endoftext|> é 日本 🙂"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string")


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The same with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "rep", "digest", "piece", "length", "rank", "block", "kind", "words", "term", "kept", "class_id", "component", "count", "lines", "window", "value")
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
