import pytest
from pyspark.sql import functions as F

from lectern.session import ship_package

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
CLASHES = ("score", "predicted", "hash", "key", "rep", "cluster", "block", "size", "target", "kept", "n_words", "host", "_class", "w", "part", "p")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon tonight.", "en", "a"),
        (1, "The cat sat on the mat and looked at the moon tonight.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", "b"),
        (4, " \n\t ", None, None),
        (5, LONG, "en", "b"),
        (None, "Ein Text ohne Nummer.", "de", None),
        (None, None, None, None),
        (7, "!!! ??? ...", "fr", "c"),
        (8, "The cat sat on the mat and looked at the moon tonight.", "en", "c"),
        (9, "x", "es", "d"),
        (10, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 \x00 \ud7ff ÀÉ é́ 漢字", "fr", "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


@pytest.fixture(scope="session")
def hard_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (3, 0, 0), (5, None, 1), (7, 0, 1), (None, 1, 1), (9, 1, None), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("mine"))
