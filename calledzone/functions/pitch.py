"""Columns of a pitch: dates out of game names, zone-relative height, call flags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from calledzone import schema as S


def game_date(game_name: Column) -> Column:
    """Date held in a game name by position; null when the text is no date."""
    parts = [F.substring(game_name, at, length) for at, length in ((5, 4), (10, 2), (13, 2))]
    return F.concat_ws("-", *parts).try_cast("date")


def zone_midpoint(top: Column, bottom: Column) -> Column:
    return (top + bottom) / F.lit(2.0)


def scaled_height(pz: Column, top: Column, bottom: Column) -> Column:
    """Height on a scale where the zone's top is +1 and its bottom -1; null for a flat zone."""
    half = (top - bottom) / F.lit(2.0)
    return F.try_divide(pz - zone_midpoint(top, bottom), half)


def strike_flag(des: Column) -> Column:
    return (des == S.STRIKE).cast("int")


def is_called(des: Column) -> Column:
    """Judged by the umpire; letter case is ignored as in the source database."""
    return F.lower(des).isin(*[call.lower() for call in S.CALLED])


def is_called_like(des: Column) -> Column:
    """The looser rule of the zone-scale averages: any text starting like a call."""
    text = F.lower(des)
    return F.greatest(*[text.startswith(prefix.lower()) for prefix in S.CALLED_PREFIXES])


def in_naive_box(px: Column, pz: Column) -> Column:
    box = S.NAIVE_BOX
    inside = (
        (px > box["left"]) & (px < box["right"]) & (pz > box["low"]) & (pz < box["high"])
    )
    return inside.cast("int")


def bucket(feet: Column, per_foot: int = S.BUCKETS_PER_FOOT) -> Column:
    """Square the coordinate falls in, rounding toward minus infinity."""
    return F.floor(feet * F.lit(float(per_foot))).cast("int")


def bucket_edge(index: Column, per_foot: int = S.BUCKETS_PER_FOOT) -> Column:
    return index / F.lit(float(per_foot))
