"""Batter zones and strike-zone areas."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import pitch as P
from calledzone.operators import calendars as C
from calledzone.operators import grids as G
from calledzone.operators.buckets import bucket_area, bucket_models
from calledzone.operators.models import of_kind, with_fallback
from calledzone.operators.pitches import batter_seasons, main_hands, zone_scale
from calledzone.plans.training import yearly_tasks
from calledzone.session import materialise
from calledzone.sources.tables import GameTables


def batter_zones(atbats: DataFrame, models: DataFrame, after_season: int) -> DataFrame:
    """Zone limits of every batter-season, from its own net or its hand's pooled net.

    Each net is laid over the grid once; batters then pick the limits they need.
    """
    nets = models.where(F.col("kind").isin(S.BATTER, S.BATTER_GENERIC))
    nets = nets.where(F.col("season") > after_season)
    named = nets.select("model_key", "kind", "entity_id", "season", "stand")
    limits = G.zone_extents(nets).join(named, "model_key")
    limits = materialise(limits.withColumn("pick", F.struct("sz_top", "sz_bot")))
    own = of_kind(limits, S.BATTER).select(
        F.col("entity_id").alias("id"), F.col("season").alias("year"), "pick"
    )
    pooled = of_kind(limits, S.BATTER_GENERIC).select(F.col("season").alias("year"), "stand", "pick")
    batters = batter_seasons(atbats, after_season)
    return with_fallback(batters, main_hands(atbats), own, pooled).select(
        F.col("id").cast("int").alias("batter"), "year", "pick.sz_top", "pick.sz_bot", "generic"
    )


def net_area(tables: GameTables, models: DataFrame) -> DataFrame:
    """Square inches of the season nets' zones, stretched to the batters' average height."""
    nets = of_kind(models, S.UMPIRE_GENERIC, C.SEASON)
    cells = G.strike_cells(nets).join(
        nets.select("model_key", F.col("season").alias("year"), "stand"), "model_key"
    )
    heights = zone_scale(tables).select("year", "stand", "height")
    return cells.join(heights, ["year", "stand"]).select(
        "year", "stand", G.square_inches(F.col("cells"), F.col("height")).alias("area")
    )


def season_bucket_area(fact: DataFrame, games: DataFrame) -> DataFrame:
    return bucket_area(bucket_models(fact, yearly_tasks(games)))


def area_report(net: DataFrame, bucket: DataFrame) -> DataFrame:
    """Both areas side by side; matched by season and hand, not by row order."""
    mine = net.withColumnRenamed("area", "my_area")
    other = bucket.withColumnRenamed("area", "roegele_area")
    return mine.join(other, ["year", "stand"]).withColumn(
        "diff", F.col("my_area") - F.col("roegele_area")
    )


def bucket_map(buckets: DataFrame) -> DataFrame:
    """Bucket models as tiles: lower left corner in feet, and ratio."""
    return buckets.select(
        "season", "stand",
        P.bucket_edge(F.col("grid_x")).alias("x"), P.bucket_edge(F.col("grid_z")).alias("y"), "ratio",
    )
