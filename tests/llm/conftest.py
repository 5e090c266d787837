import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named like results and work columns of the operators.
CLASHES = ("digest", "h", "kept", "keep_id", "bits", "block", "cid", "ids", "decoded", "score", "label", "__id", "n", "id")
LOREM = "the quick brown fox jumps over the lazy dog and runs far away from the loud red barn near the old mill"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977} {i}" for i in range(20000))
    return [
        (1, LOREM), (2, LOREM), (3, LOREM + " today"), (4, ""), (5, None), (6, "one two"), (7, "one two"), (7, "one two"),
        (8, long_text), (9, long_text + " end"), (10, " \t\n"), (11, "Ünïcödé ▁ text\r\n\x00 日本 😀 " * 40), (12, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in odd_rows], SCHEMA)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
