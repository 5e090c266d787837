"""Pitches of many date windows at once, and the latest N of each window, exactly.

Windows are opened into days, so that a window join is an equality join on the
day. The latest N pitches of a window are found by counting: per day, then by a running
count over ranges of ids in the one day the limit falls in. No task ever sorts a whole
window or day, and the read behind it keeps just the rows past a cut point.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calledzone.operators.running import with_running
from calledzone.session import materialise, small_side

SLICE_ROWS = 250_000


def open_days(tasks: DataFrame) -> DataFrame:
    """One row per task and day of its window."""
    days = F.sequence("d_s", F.date_sub("d_e", 1), F.expr("interval 1 day"))
    return tasks.where(F.col("d_s") < F.col("d_e")).withColumn("game_date", F.explode(days))


def assign_windows(fact: DataFrame, tasks: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pitches of each task's window; a pitch appears once per window it lies in.

    `on` names the columns, besides the day, a task shares with its pitches:
    ("stand",) for pooled tasks, ("umpire", "stand") for single umpires, () for
    tasks over all hands.
    """
    keys = [*on, "game_date"]
    days = open_days(tasks).select("model_key", *keys)
    return fact.join(small_side(days), keys)


def recent_cutoffs(
    fact: DataFrame, tasks: DataFrame, on: Sequence[str], limit: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Where each task's latest `limit` pitches begin: (model_key, cut_date, cut_id).

    Order is latest day first, then highest pitch id. Tasks below the limit are left out. The pitches are
    read twice: counted per day, then ranked within the days some limit falls in, `slice_rows` of them a task.
    """
    keys = [*on, "game_date"]
    daily = fact.groupBy(*keys).agg(F.count("*").alias("rows"))
    by_day = Window.partitionBy("model_key").orderBy(F.desc("game_date")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    days = open_days(tasks).select("model_key", *keys).join(daily, keys)
    days = days.withColumn("later", F.coalesce(F.sum("rows").over(by_day), F.lit(0)))
    reached = (F.col("later") < limit) & (F.col("later") + F.col("rows") >= limit)
    need = (F.lit(limit) - F.col("later")).alias("place")
    edges = materialise(days.where(reached).select("model_key", *keys, need, "rows"))
    # Windows of many models end on one day: it is ranked once for all of them.
    shared = edges.select(*keys, "rows").distinct()
    total = shared.agg(F.sum("rows")).first()[0] or 0
    rows = fact.select(*keys, "pitch_id", F.lit(1).alias("one")).join(small_side(shared.drop("rows")), keys, "left_semi")
    ranked = with_running(rows, keys, [F.desc("pitch_id")], {"place": "one"}, ranges=max(1, -(-total // slice_rows)))
    return ranked.join(small_side(edges.drop("rows")), [*keys, "place"]).select(
        "model_key", F.col("game_date").alias("cut_date"), F.col("pitch_id").alias("cut_id"))


def latest_per_window(
    fact: DataFrame, tasks: DataFrame, on: Sequence[str], limit: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """As `assign_windows`, keeping the latest `limit` pitches of each task."""
    cuts = recent_cutoffs(fact, tasks, on, limit, slice_rows)
    tasks = tasks.join(cuts, "model_key", "left")
    tasks = materialise(
        tasks.withColumn("d_s", F.greatest("d_s", F.coalesce("cut_date", "d_s")))
    )
    keys = [*on, "game_date"]
    days = open_days(tasks).select("model_key", *keys, "cut_date", "cut_id")
    kept = (
        F.col("cut_date").isNull()
        | (F.col("game_date") > F.col("cut_date"))
        | (F.col("pitch_id") >= F.col("cut_id"))
    )
    return fact.join(small_side(days), keys).where(kept).drop("cut_date", "cut_id")
