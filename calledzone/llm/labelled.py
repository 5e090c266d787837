"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import held_out, two_columns


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled ids outside the held-out third, least hash first.

    The ids are few by construction, so they are broadcast and no text is shuffled. Labels that are null or neither
    0 nor 1 teach nothing; of several labels of an id the largest counts.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return two_columns(docs).join(F.broadcast(ids), "doc_id")
