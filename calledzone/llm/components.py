"""Connected components of a link table, as rounds of joins: no graph is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, keep


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest id around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # No more rows than links; the small star behind it removes repeated ones.
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    down = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return down.unionByName(own).filter("u > v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link down and none of the lower ends has a link of its own."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("upper")).unionByName(
        links.select(F.col("v").alias("id"), F.lit(0).alias("upper")))
    found = ends.groupBy("id").agg(F.sum("upper").alias("links"), F.min("upper").alias("lower"))
    return found.filter("links > 1 or links = 1 and lower = 0").agg(F.count(F.lit(1))).first()[0] == 0


def star_links(comps: DataFrame) -> DataFrame:
    """Links (a, b) that join what the components (id, component) join."""
    return comps.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id named in the links (a, b); component is the smallest id reachable.

    Alternating large-star and small-star rounds, each cut by a written table, until the links are stars.
    Nulls and self links are left out; no links give an empty table.
    """
    now = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .filter("u > v").distinct(), "links")
    while not _are_stars(now):
        after = keep(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
