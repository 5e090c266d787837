"""The called-pitch fact and the lists counted from it."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import pitch as P
from calledzone.sources.tables import GameTables, with_calendar


def officiated_games(tables: GameTables, game_types: Iterable[str]) -> DataFrame:
    """One row per game of the wanted types and its home-plate umpire."""
    games = tables.games.where(F.col("type").isin(*game_types)).select("gameName")
    crew = tables.umpires.where(F.col("position") == S.HOME_PLATE)
    return games.join(crew.select("gameName", F.col("id").alias("umpire")), "gameName")


def _season_key(*stored: DataFrame) -> list[str]:
    """Ingested tables also join on season, so that a season filter skips folders of all of them."""
    return ["season"] if all("season" in df.columns for df in stored) else []


def called_pitches(
    tables: GameTables,
    *,
    game_types: Iterable[str] | None = (S.REGULAR,),
    with_umpire: bool = True,
    with_zone: bool = True,
    hands: Iterable[str] | None = None,
    known_height: bool = False,
    known_location: bool = True,
    like_calls: bool = False,
) -> DataFrame:
    """Pitches the umpire judged, with at-bat, game, umpire and batter zone attached.

    Games, umpires and zones are joined to the at-bats, which are several times
    fewer than the pitches, so the pitches move in one shuffle only.
    """
    season_key = _season_key(tables.atbats, tables.pitches)
    atbats = with_calendar(tables.atbats)
    if hands is not None:
        atbats = atbats.where(F.col("stand").isin(*hands))
    if known_height:
        atbats = atbats.where(F.col("b_height_in") != 0)
    atbats = atbats.select(
        "gameName", F.col("num").alias("gameAtBatID"), "game_date", "season", "month",
        "batter", "stand",
    )
    if with_umpire:
        atbats = atbats.join(officiated_games(tables, game_types), "gameName")
    elif game_types is not None:
        games = tables.games.where(F.col("type").isin(*game_types)).select("gameName")
        atbats = atbats.join(games, "gameName")
    if with_zone:
        zones = tables.zones.select(
            F.col("batter").cast("long").alias("batter"), F.col("year").alias("season"),
            "sz_top", "sz_bot",
        )
        atbats = atbats.join(zones, ["batter", "season"])

    called = P.is_called_like if like_calls else P.is_called
    pitches = tables.pitches.where(called(F.col("des")))
    if known_location:
        pitches = pitches.where(F.col("px").isNotNull() & F.col("pz").isNotNull())
    pitches = pitches.select(
        "gameName", "gameAtBatID", *season_key, F.col("gamedayPitchID").alias("pitch_id"),
        "px", "pz", "pfx_x", "pfx_z", P.strike_flag(F.col("des")).alias("c"),
    )
    keys = ["gameName", "gameAtBatID", *season_key]
    fact = pitches.join(atbats, keys).drop("gameName", "gameAtBatID")
    if with_zone:
        top, bottom = F.col("sz_top"), F.col("sz_bot")
        fact = fact.withColumn("sz_mid", P.zone_midpoint(top, bottom)).withColumn(
            "pz_ratio", P.scaled_height(F.col("pz"), top, bottom)
        )
    return fact


def judged_pitches(tables: GameTables, game_types: Iterable[str] = (S.REGULAR,)) -> DataFrame:
    """All called pitches of officiated games, for jobs that need several views of them.

    `called_pitches` with a zone is `has_zone` here, with known height `known_height`; written
    once, one shuffle of the pitches serves lists, fits and scores.
    """
    atbats = tables.atbats.select("gameName", "num", "batter", "stand", "b_height_in", *[
        c for c in ("game_date", "season", "month") if c in tables.atbats.columns])
    zones = tables.zones.select(
        F.col("batter").cast("long").alias("batter"), F.col("year").alias("season"), "sz_top", "sz_bot",
        F.lit(True).alias("has_zone"))
    atbats = with_calendar(atbats).join(officiated_games(tables, game_types), "gameName")
    atbats = atbats.join(zones, ["batter", "season"], "left").select(
        "gameName", F.col("num").alias("gameAtBatID"), "game_date", "season", "month", "umpire", "batter", "stand",
        F.coalesce(F.col("b_height_in") != 0, F.lit(False)).alias("known_height"),
        F.coalesce("has_zone", F.lit(False)).alias("has_zone"), "sz_top", "sz_bot")
    season_key = _season_key(tables.atbats, tables.pitches)
    pitches = tables.pitches.where(P.is_called(F.col("des")) & F.col("px").isNotNull() & F.col("pz").isNotNull()).select(
        "gameName", "gameAtBatID", *season_key, F.col("gamedayPitchID").alias("pitch_id"),
        "px", "pz", "pfx_x", "pfx_z", P.strike_flag(F.col("des")).alias("c"))
    fact = pitches.join(atbats, ["gameName", "gameAtBatID", *season_key]).drop("gameName", "gameAtBatID")
    top, bottom = F.col("sz_top"), F.col("sz_bot")
    return fact.withColumn("sz_mid", P.zone_midpoint(top, bottom)).withColumn(
        "pz_ratio", P.scaled_height(F.col("pz"), top, bottom))


def umpire_names(umpires: DataFrame) -> DataFrame:
    """One name per umpire id; the smallest, so that it is always the same one."""
    return umpires.groupBy("id").agg(F.min("name").alias("name"))


def umpire_pitch_counts(tables: GameTables, *extra: str, where=None, judged: DataFrame | None = None) -> DataFrame:
    """Called pitches per umpire, season and `extra` columns; names are joined to the counts.

    `judged` may give the rows of `judged_pitches` where they are written already.
    """
    fact = called_pitches(tables, with_zone=False, known_height=True) if judged is None else judged.where("known_height")
    if where is not None:
        fact = fact.where(where)
    counts = fact.groupBy(F.col("umpire").alias("id"), "season", *extra).agg(
        F.count("*").alias("pcount")
    )
    return counts.join(umpire_names(tables.umpires), "id").select(
        "name", "id", *extra, F.col("season").alias("year"), "pcount"
    )


def umpire_seasons(tables: GameTables, first_season: int, last_season: int) -> DataFrame:
    return umpire_pitch_counts(tables, where=F.col("season").between(first_season, last_season))


def umpire_months(
    tables: GameTables, last_season: int, after_month: int = 0, judged: DataFrame | None = None
) -> DataFrame:
    """Umpire-months per hand: the individual fit list, or the scoring list with after_month=4."""
    where = (F.col("season") <= last_season) & (F.col("month") > after_month)
    return umpire_pitch_counts(tables, "stand", "month", where=where, judged=judged)


def batter_seasons(atbats: DataFrame, after_season: int) -> DataFrame:
    return (
        with_calendar(atbats)
        .where(F.col("season") > after_season)
        .select(F.col("batter").alias("id"), F.col("season").alias("year"))
        .distinct()
    )


def main_hands(atbats: DataFrame) -> DataFrame:
    """The hand each batter used most in a season; a tie goes to the first letter."""
    per_hand = with_calendar(atbats).groupBy("batter", "season", "stand").agg(
        F.count("*").alias("ab")
    )
    best = F.min(F.struct((-F.col("ab")).alias("order"), "stand", "ab")).alias("best")
    return per_hand.groupBy("batter", "season").agg(best).select(
        "batter", "season", F.col("best.stand").alias("stand"), F.col("best.ab").alias("ab")
    )


def zone_scale(tables: GameTables) -> DataFrame:
    """Average zone limits and height per season and hand, over all game types."""
    fact = called_pitches(
        tables, game_types=None, with_umpire=False, known_location=False, like_calls=True
    )
    averages = fact.groupBy(F.col("season").alias("year"), "stand").agg(
        F.count("*").alias("n"), F.avg("sz_top").alias("top"), F.avg("sz_bot").alias("bot")
    )
    return averages.withColumn("height", F.col("top") - F.col("bot"))


def season_range(games: DataFrame) -> DataFrame:
    """First and last regular-season day of each season, with the early and late month flags."""
    days = with_calendar(games).where(F.col("type") == S.REGULAR)
    first, last = F.col("min_date"), F.col("max_date")
    return (
        days.groupBy("season")
        .agg(F.min("game_date").alias("min_date"), F.max("game_date").alias("max_date"))
        .withColumn("has_mar_games", (F.month(first) < 4).cast("int"))
        .withColumn("has_oct_games", (F.month(last) > 9).cast("int"))
    )
