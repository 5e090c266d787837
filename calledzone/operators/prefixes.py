"""Sums over many date windows at once, each pitch counted in one place.

The days of a season are cut where some window begins or ends, and rows are added up per stretch between two cuts. A
window of one stretch takes its sum. Windows from the season's first cut on (year to date) are prefixes: sums run along the
season once, and a window takes the running total that stands at its end. Other windows add up their
stretches. So overlapping windows repeat neither pitches nor days, and what is made has the size of the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calledzone.session import materialise, small_side


def season_cuts(tasks: DataFrame) -> DataFrame:
    """(season, cuts): the days on which a window of the season begins or ends, in order; two a window at most."""
    days = tasks.where("d_s < d_e").select("season", F.explode(F.array("d_s", "d_e")).alias("day"))
    return days.groupBy("season").agg(F.sort_array(F.collect_set("day")).alias("cuts"))


def _cuts_upto(day: str) -> Column:
    return F.size(F.filter("cuts", lambda cut: cut <= F.col(day)))


def day_stretches(cuts: DataFrame) -> DataFrame:
    """(game_date, season, stretch) for every day between the first and the last cut of a season, numbered from 1."""
    days = cuts.select("season", "cuts", F.explode(F.sequence(
        F.element_at("cuts", 1), F.date_sub(F.element_at("cuts", -1), 1), F.expr("interval 1 day"))).alias("game_date"))
    return days.select("game_date", "season", _cuts_upto("game_date").alias("stretch"))


def _edges(tasks: DataFrame, cuts: DataFrame, on: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Tasks with the first and the last stretch of their windows."""
    names = list(dict.fromkeys([*carry, "season", *on]))
    return tasks.where("d_s < d_e").join(small_side(cuts), "season").select(
        *names, _cuts_upto("d_s").alias("first"), (_cuts_upto("d_e") - 1).alias("last"))


def window_sums(
    rows: DataFrame, tasks: DataFrame, on: Sequence[str], keys: Sequence[str], sums: Sequence[str],
    carry: Sequence[str] = ("model_key",),
) -> DataFrame:
    """Sums of `rows` per task and `keys`: the task's columns `carry`, `keys` and `sums`; none where a task has no rows.

    `rows` has game_date, the columns `on` (besides the day, what a task shares with its rows) and `keys`. A task's season
    names its window's season; a window may reach over the end of the year.
    """
    cuts = materialise(season_cuts(tasks))
    edges = materialise(_edges(tasks, cuts, on, carry))
    days = materialise(day_stretches(cuts))
    per_stretch = rows.join(small_side(days), "game_date").groupBy("season", *on, *keys, "stretch").agg(
        *[F.sum(name).alias(name) for name in sums])
    shapes = {(row["short"], row["prefix"]) for row in edges.select(
        (F.col("first") == F.col("last")).alias("short"), (F.col("first") == 1).alias("prefix")).distinct().collect()}
    short = F.col("first") == F.col("last")
    wide_prefix, wide_inner = ~short & (F.col("first") == 1), ~short & (F.col("first") > 1)
    kinds = sum([any(s for s, _ in shapes), (False, True) in shapes, (False, False) in shapes])
    if kinds > 1:
        per_stretch = materialise(per_stretch)
    out = list(dict.fromkeys([*carry, *keys]))
    found = []
    if any(s for s, _ in shapes):
        one = edges.where(short).withColumnRenamed("first", "stretch").drop("last")
        found.append(per_stretch.join(small_side(one), ["season", *on, "stretch"]).select(*out, *sums))
    if (False, True) in shapes:
        found.append(_prefix_sums(per_stretch, edges.where(wide_prefix), on, keys, sums, out))
    if (False, False) in shapes:
        opened = edges.where(wide_inner).withColumn("stretch", F.explode(F.sequence("first", "last"))).drop("first", "last")
        met = per_stretch.join(small_side(opened), ["season", *on, "stretch"])
        found.append(met.groupBy(*out).agg(*[F.sum(name).alias(name) for name in sums]))
    if not found:
        return per_stretch.join(edges.limit(0), ["season", *on]).select(*out, *sums)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _prefix_sums(per_stretch, edges, on, keys, sums, out) -> DataFrame:
    """Windows that begin with their season: the running total that stands at their last stretch."""
    order = Window.partitionBy("season", *on, *keys).orderBy("stretch")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_stretch.select(
        "season", *on, *keys, "stretch", F.lead("stretch").over(order).alias("until"),
        *[F.sum(name).over(upto).alias(name) for name in sums])
    # Where the windows of a season end, as a list, so that a total is opened for those ends alone.
    ends = edges.groupBy("season", *on).agg(F.sort_array(F.collect_set("last")).alias("ends"))
    standing = running.join(small_side(materialise(ends)), ["season", *on]).withColumn("last", F.explode(F.filter(
        "ends", lambda end: (end >= F.col("stretch")) & (F.col("until").isNull() | (end < F.col("until"))))))
    return standing.drop("ends", "stretch", "until").join(
        small_side(edges.drop("first")), ["season", *on, "last"]).select(*out, *sums)
