import pytest
from pyspark.sql import functions as F

#: Names that operators use or return themselves; inputs may have them too.
CLASHING = ["size", "key", "ids", "score", "n_tokens", "path", "a", "b", "component_id", "taken", "position", "group", "target", "held_out", "n_lines", "shard", "chunk", "node", "label", "line"]

TRICKY = [
    (1, "Hello world, it's 2024!\n\nnaïve  façade we'll SEE"), (2, None), (3, ""), (4, " \t\n "), (5, "ÀÉ 中文字 🙂 <|endoftext|> ́x"), (6, "a" * 5000 + " " + "!?" * 500 + " word" * 20000),
    (7, "Hello world, it's 2024!\n\nnaïve  façade we'll SEE"), (7, "Hello world, it's 2024!\n\nnaïve  façade we'll SEE"), (None, "a text without an id\n"), (None, None),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash."""

    def make(rows, partitions=3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        return df.select("*", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "web").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(0).alias(c) for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def tricky(docs_of):
    return docs_of(TRICKY)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
