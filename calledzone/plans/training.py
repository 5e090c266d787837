"""Fit jobs: which windows to fit, on which pitches, by which rule."""

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.operators import calendars as C
from calledzone.operators import fits
from calledzone.operators.buckets import bucket_models
from calledzone.operators.models import pending
from calledzone.operators.pitches import batter_seasons, called_pitches, season_range, umpire_months
from calledzone.operators.prefixes import window_sums
from calledzone.operators.windows import assign_windows, latest_per_window
from calledzone.session import materialise, small_side
from calledzone.sources.sinks import ModelStore
from calledzone.sources.tables import GameTables, with_calendar


@dataclass(frozen=True)
class Kind:
    """What one kind of net is trained on."""

    name: str
    features: Sequence[str]
    rule: fits.FitRule
    on: Sequence[str]
    limit: int | None


# A fit that does not end well is begun again from other weights, so many times in all.
STARTS = 10


def _again(rule: fits.FitRule) -> fits.FitRule:
    return replace(rule, starts=STARTS)


POOLED = Kind(
    S.UMPIRE_GENERIC, S.ZONE_FEATURES, _again(fits.POOLED_RULE), ("stand",), S.MAX_TRAINING_PITCHES
)
MOVEMENT = Kind(
    S.UMPIRE_MOVEMENT, S.MOVEMENT_FEATURES, _again(fits.MOVEMENT_RULE), ("stand",), S.MAX_TRAINING_PITCHES
)
INDIVIDUAL = Kind(
    S.UMPIRE_INDIVIDUAL, S.ZONE_FEATURES, _again(fits.INDIVIDUAL_RULE), ("umpire", "stand"),
    S.MAX_TRAINING_PITCHES,
)
BATTERS = Kind(S.BATTER, S.BATTER_FEATURES, _again(fits.BATTER_RULE), ("batter",), None)
BATTERS_POOLED = Kind(
    S.BATTER_GENERIC, S.BATTER_FEATURES, _again(fits.BATTER_RULE), ("stand",), S.MAX_TRAINING_PITCHES
)


def umpire_training_fact(tables: GameTables, incl_spring: bool = False) -> DataFrame:
    """Pitches umpire models may be trained on: height, zone and location known."""
    types = (S.REGULAR, S.SPRING) if incl_spring else (S.REGULAR,)
    return called_pitches(tables, game_types=types, known_height=True)


def batter_training_fact(tables: GameTables) -> DataFrame:
    return called_pitches(tables, with_umpire=False, with_zone=False)


def daily_tasks(games: DataFrame) -> DataFrame:
    return C.as_tasks(C.per_hand(C.day_windows(season_range(games))), S.UMPIRE_GENERIC)


def monthly_tasks(games: DataFrame, kind: str = S.UMPIRE_GENERIC) -> DataFrame:
    return C.as_tasks(C.per_hand(C.month_windows(season_range(games))), kind)


def yearly_tasks(games: DataFrame, kind: str = S.UMPIRE_GENERIC) -> DataFrame:
    return C.as_tasks(C.per_hand(C.year_windows(season_range(games))), kind)


def individual_tasks(tables: GameTables, last_season: int, judged: DataFrame | None = None) -> DataFrame:
    """Year-to-date windows of every umpire-month and hand in the umpire list."""
    listed = umpire_months(tables, last_season, judged=judged).where(F.col("stand").isin(*S.HANDS)).select(
        F.col("id").alias("entity_id"), F.col("year").alias("season"), "month", "stand"
    )
    return C.as_tasks(C.year_to_date(listed), S.UMPIRE_INDIVIDUAL)


def batter_tasks(atbats: DataFrame, after_season: int) -> DataFrame:
    """Whole-season windows, closing day included: batter nets take all of a season."""
    batters = batter_seasons(atbats, after_season).select(
        F.col("id").alias("entity_id"), F.col("year").alias("season")
    )
    return C.as_tasks(_whole_season(batters), S.BATTER)


def batter_pooled_tasks(atbats: DataFrame, after_season: int) -> DataFrame:
    seasons = with_calendar(atbats).where(F.col("season") > after_season).select("season").distinct()
    return C.as_tasks(C.per_hand(_whole_season(seasons)), S.BATTER_GENERIC)


def _whole_season(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("d_s", F.make_date("season", F.lit(1), F.lit(1)))
        .withColumn("d_e", F.make_date(F.col("season") + 1, F.lit(1), F.lit(1)))
        .withColumn("span", F.lit(C.SEASON))
    )


def training_rows(fact: DataFrame, tasks: DataFrame, kind: Kind, limit: int | None = None) -> DataFrame:
    """Pitches each task is fitted on, the latest `limit` of its window."""
    limit = kind.limit if limit is None else limit
    if kind.name == S.BATTER:
        # A batter-season is its own key: the model's name is built, not looked up.
        keys = tasks.select("model_key", F.col("entity_id").alias("batter"), "season")
        return fact.join(keys, ["batter", "season"])
    if "umpire" in kind.on:
        tasks = tasks.withColumn("umpire", F.col("entity_id"))
    if limit is None:
        return assign_windows(fact, tasks, kind.on)
    return latest_per_window(fact, tasks, kind.on, limit)


def training_sizes(fact: DataFrame, tasks: DataFrame, kind: Kind, limit: int | None = None) -> DataFrame:
    """(model_key, n): how many pitches each task has, from counts alone; tasks without pitches are left out."""
    limit = kind.limit if limit is None else limit
    if kind.name == S.BATTER:
        counts = fact.groupBy(F.col("batter").alias("entity_id"), "season").agg(F.count("*").alias("n"))
        sizes = tasks.select("model_key", "entity_id", "season").join(counts, ["entity_id", "season"])
    else:
        rows = fact.select(*kind.on, "game_date", F.lit(1).alias("n"))
        sizes = window_sums(rows, tasks.withColumn("umpire", F.col("entity_id")), kind.on, (), ("n",))
    n = F.col("n") if limit is None else F.least(F.col("n"), F.lit(limit))
    return sizes.select("model_key", n.alias("n"))


def train(
    fact: DataFrame, tasks: DataFrame, kind: Kind, *,
    rule: fits.FitRule | None = None, limit: int | None = None,
    task_points: int = fits.TASK_POINTS,
) -> DataFrame:
    """Fit every task; one row per task, whatever came of it.

    The columns the fit reads are written once, for the tasks' seasons alone, as the
    latest pitches of a window are found in several reads.
    """
    columns = {*kind.on, "game_date", "season", "pitch_id", "c", *kind.features}
    tasks = materialise(tasks)
    seasons = [row["season"] for row in tasks.select("season").distinct().collect()]
    fact = fact.where(F.col("season").isin(*seasons))
    fact = materialise(fact.select(*sorted(columns)))
    rule = rule or kind.rule
    # Windows with too few pitches are known from counts, before any pitch is moved for them.
    sizes = materialise(training_sizes(fact, tasks, kind, limit).where(F.col("n") >= rule.min_rows))
    wanted = tasks.join(small_side(sizes.select("model_key")), "model_key", "left_semi")
    rows = training_rows(fact, wanted, kind, limit)
    points = fits.training_points(rows, kind.features)
    fitted = fits.fit_nets(
        points, kind.features, rule, most_points=limit or kind.limit, task_points=task_points, sizes=sizes,
    )
    return fits.with_fits(tasks, fitted)


def train_and_save(
    store: ModelStore, fact: DataFrame, tasks: DataFrame, kind: Kind, *,
    overwrite: bool = True, **options,
) -> None:
    """Fit and store; without `overwrite` only tasks that have no stored model."""
    if not overwrite:
        tasks = pending(tasks, store.current())
    store.save(train(fact, tasks, kind, **options))


def save_buckets(store: ModelStore, fact: DataFrame, tasks: DataFrame) -> None:
    """Bucket models of the windows and hands of `tasks`."""
    store.save_buckets(bucket_models(fact.where(F.col("stand").isin(*S.HANDS)), tasks))


def train_and_save_buckets(store: ModelStore, fact: DataFrame, games: DataFrame) -> None:
    """Bucket models of all months and hands."""
    save_buckets(store, fact, monthly_tasks(games))


def batch_daily(store, tables: GameTables, **options) -> None:
    options.setdefault("limit", S.MAX_DAILY_TRAINING_PITCHES)
    train_and_save(store, umpire_training_fact(tables), daily_tasks(tables.games), POOLED, **options)


def batch_monthly(store, tables: GameTables, movement: bool = True, **options) -> None:
    kind = MOVEMENT if movement else POOLED
    options.setdefault("overwrite", False)
    tasks = monthly_tasks(tables.games, kind.name)
    train_and_save(store, umpire_training_fact(tables), tasks, kind, **options)


def batch_yearly(store, tables: GameTables, seasons: Sequence[int], **options) -> None:
    tasks = yearly_tasks(tables.games).where(F.col("season").isin(*seasons))
    fact = umpire_training_fact(tables).where(F.col("season").isin(*seasons))
    train_and_save(store, fact, tasks, POOLED, **options)


def batch_individual(store, tables: GameTables, last_season: int, **options) -> None:
    options.setdefault("overwrite", False)
    tasks = individual_tasks(tables, last_season)
    train_and_save(store, umpire_training_fact(tables), tasks, INDIVIDUAL, **options)


def batch_batters(store, tables: GameTables, after_season: int, **options) -> None:
    """Pooled nets per season and hand, then a net per batter with enough pitches.

    Stored models are kept, as in the umpire lists; the refresh removes a
    season's models first.
    """
    options.setdefault("overwrite", False)
    fact = batter_training_fact(tables).where(F.col("season") > after_season)
    pooled = batter_pooled_tasks(tables.atbats, after_season)
    train_and_save(store, fact, pooled, BATTERS_POOLED, **options)
    train_and_save(store, fact, batter_tasks(tables.atbats, after_season), BATTERS, **options)
