"""The refresh: back up, fit, repair, zones, areas, evaluation, reports; of a season, or of all that new games touch."""

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.plans import evaluation, repair, training, zones
from calledzone.session import materialise, small_side
from calledzone.sources import sinks
from calledzone.sources.lake import Lake
from calledzone.sources.published import Versions
from calledzone.sources.tables import GameTables


@dataclass(frozen=True)
class RefreshPaths:
    zones: str
    ucs: str
    reports: str


def refresh(
    tables: GameTables, store: sinks.ModelStore, paths: RefreshPaths, season: int,
    run_day: date, started: datetime, umpire_options: dict | None = None,
    batter_options: dict | None = None,
) -> dict[str, str]:
    """Bring a season, and batters from it on, up to date; returns where each report was written."""
    spark = tables.pitches.sparkSession
    umpire_options, batter_options = umpire_options or {}, batter_options or {}
    batter_kinds = (S.BATTER, S.BATTER_GENERIC)
    store.backup(season, (S.UMPIRE_GENERIC, *batter_kinds), started)
    store.remove_season(season, batter_kinds)

    training.batch_batters(store, tables, after_season=season - 1, **batter_options)
    repair.repair_batters(store, tables, **batter_options)
    limits = zones.batter_zones(tables.atbats, store.current(), after_season=season - 1)
    zones_table = sinks.zones_table(spark, paths.zones)
    sinks.write_batter_zones(limits, zones_table)
    known = zones_table.read()
    # Seasons the store has no zones of keep those they came with, so that older nets can be refitted.
    others = tables.zones.join(small_side(known.select("year").distinct()), "year", "left_anti")
    tables = tables.with_zones(known.unionByName(others.select(*known.columns)))

    training.batch_yearly(store, tables, [season], **umpire_options)
    repair.repair_umpires(store, tables, **umpire_options)
    models = store.current().where(F.col("season") == season)

    columns = ("pitch_id", "umpire", "game_date", "season", "stand", "c", "pz", *S.ZONE_FEATURES)
    fact = evaluation.evaluation_fact(tables).where(F.col("season") == season)
    fact = materialise(fact.select(*columns))
    area = zones.area_report(
        zones.net_area(tables, models), zones.season_bucket_area(fact, tables.games)
    )
    scores = sinks.scores_table(spark, paths.ucs)
    sinks.write_umpire_ucs(evaluation.season_scores(fact, models), scores)
    ucs = scores.read().where(F.col("season") == season)
    store.compact()
    by_umpire = evaluation.extra_strikes_by_umpire(ucs, tables.umpires, season, season)
    by_season = evaluation.extra_strikes_by_season(ucs, season, season)
    return {
        name: sinks.write_report(report, paths.reports, name, run_day)
        for name, report in (
            ("sz_area", area.where(F.col("year") == season)),
            ("results", by_umpire), ("results_tot", by_season),
        )
    }


def refresh_new(
    raw: GameTables, lake: Lake, store: sinks.ModelStore, paths: RefreshPaths, run_day: date, started: datetime,
    **options,
) -> dict[int, dict[str, str]]:
    """Take the new games of `raw` into the lake, then refresh the seasons whose rows changed; reports by season.

    Which version of the lake a season was last refreshed from is published after its reports, so a season whose
    refresh was cut short is refreshed by the next run, new games or not.
    """
    lake.ingest(raw)
    version = lake.version()
    state = Versions(lake.spark, f"{paths.reports}/_seasons")
    seen = {int(season): v for season, v in state.notes().items()}
    written = {}
    for season in lake.changed_seasons(seen, version):
        zones = sinks.zones_table(lake.spark, paths.zones).read()
        tables = lake.tables(zones, version, seasons=[season])
        written[season] = refresh(tables, store, paths, season, run_day, started, **options)
        state.publish(lambda old: old, lambda old, season=season: {**old, str(season): version})
    return written
