"""Bucket model: share of called strikes in each square inch of the plate's plane."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import pitch as P
from calledzone.operators.prefixes import window_sums
from calledzone.session import small_side

WINDOW = ("season", "span", "d_s", "d_e")


def bucket_models(
    fact: DataFrame, tasks: DataFrame, on: Sequence[str] = ("stand",),
    per_foot: int = S.BUCKETS_PER_FOOT,
) -> DataFrame:
    """Bucket counts of every task in one aggregation.

    Pitches are counted once per bucket and stretch of days; windows that overlap take running totals of these counts.
    """
    square = [P.bucket(F.col("px"), per_foot).alias("grid_x"), P.bucket(F.col("pz"), per_foot).alias("grid_z")]
    rows = fact.select(*on, "game_date", *square, F.lit(1).alias("n"), F.col("c").alias("s"))
    tasks = tasks.withColumn("umpire", F.col("entity_id"))
    counts = window_sums(rows, tasks, on, ("grid_x", "grid_z"), ("n", "s"), ("entity_id", *WINDOW, "stand"))
    return counts.select(
        "entity_id", *WINDOW, "stand", "grid_x", "grid_z", "n", "s", (F.col("s") / F.col("n")).alias("ratio"))


def lookup_table(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per bucket, with how many rows the model held for it."""
    return models.groupBy(*keys, "grid_x", "grid_z").agg(
        F.count("*").alias("bucket_rows"), F.min("ratio").alias("bucket_ratio")
    )


def bucket_ratio() -> Column:
    """Score after a left join with `lookup_table`: unseen bucket 0, ambiguous bucket -1."""
    return F.when(F.col("bucket_rows") > 1, F.lit(S.DUPLICATE_BUCKET)).otherwise(
        F.coalesce(F.col("bucket_ratio"), F.lit(0.0))
    )


def bucket_score(
    pitches: DataFrame, models: DataFrame, keys: Sequence[str],
    per_foot: int = S.BUCKETS_PER_FOOT,
) -> DataFrame:
    """Add `roeg`, the ratio of each pitch's bucket in the model named by `keys`."""
    squares = pitches.withColumn("grid_x", P.bucket(F.col("px"), per_foot)).withColumn(
        "grid_z", P.bucket(F.col("pz"), per_foot)
    )
    table = lookup_table(models, keys)
    scored = squares.join(small_side(table), [*keys, "grid_x", "grid_z"], "left")
    return scored.withColumn("roeg", bucket_ratio()).drop("bucket_rows", "bucket_ratio")


def bucket_area(models: DataFrame) -> DataFrame:
    """Square inches called a strike more often than not, per season and hand."""
    inside = F.sum((F.col("ratio") > 0.5).cast("int")).alias("area")
    return models.groupBy(F.col("season").alias("year"), "stand").agg(inside)
