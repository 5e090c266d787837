"""Exact dedup: two Bloom passes find possibly repeated hashes, and only those rows are shuffled.

Built-in functions only. Texts are read once, into a table of ids and SHA-256 digests. The first pass
counts Bloom slots and keeps the bitmap of slots that are hit twice; the second probes it
without a shuffle. Rows it rules out are unique and pass straight through, the rest meet by digest.

Defined cases: null text counts as empty, and empty texts are copies of each other. Of equal texts the row
with the largest id stays; a null id loses against any other, and where all ids of a group are null each
row stays. Rows repeated with the same id and text count as copies and all carry the verdict of that id;
`drop_copies` drops an id only if none of its rows stays.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .scratch import keep, two_columns


def group_copies(digests: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(doc_id, digest) with keep_id and group_size; `digests` must be a written table.

    Hot digests are counted before the shuffle, and the join back is one whose hot keys Spark splits.
    """
    rows = digests.count()
    bits = bloom.size_for(rows, max_bits=max_bits)
    blocks = bloom.repeated(digests.select(F.xxhash64("digest").alias("h")), bits)
    flagged = bloom.probe(digests, F.xxhash64("digest"), blocks, bits)
    maybe = flagged.filter("__maybe").drop("__maybe")
    groups = keep(
        maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"), "groups")
    alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")]
    unique = flagged.filter("not __maybe").select("doc_id", "digest", *alone)
    met = maybe.join(groups, "digest", "left").select(
        "doc_id", "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    return unique.unionByName(met)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = keep(two_columns(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "digests")
    return group_copies(digests, max_bits).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` less the copies that do not stay, with all its columns."""
    verdicts = find_copies(docs, id_col, text_col)
    lost = keep(verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("any_kept"))
                .filter("not any_kept").select("doc_id"), "lost")
    return bloom.without(docs, id_col, lost, lost.count())
