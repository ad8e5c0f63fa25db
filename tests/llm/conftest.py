import os

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return sorted((r.doc_id, r.text) for r in small.collect())


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white texts, a very long one, ties, repeated rows."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, " \n\t ", None, None, 4), (4, words, "en", "a", len(words)),
        (5, "one two three four five six", "en", "b", 27), (5, "one two three four five six", "en", "b", 27),
        (6, "one two three four five six", None, "b", 27), (None, "one two three four five six", "en", None, 27),
        (7, "$$$ ### 123 %%%", "de", "b", 15), (8, "word", "de", "c", 4), (9, "Ünïcode wörds 漢字 \U0001f600 end x", "de", "c", 30),
    ]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns that have the names of results and of inner columns."""
    names = (
        "key", "n_words", "kept", "score", "lang_pred", "node", "bands", "ids", "decoded", "leaked_items",
        "removed_chars", "spans", "base", "mark", "bucket", "label", "host", "words", "shingles", "train", "block",
    )
    return odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
