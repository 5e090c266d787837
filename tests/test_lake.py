"""Game-by-game ingest, and a refresh of just the seasons that new games touch."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from calledzone.operators import fits
from calledzone.operators.pitches import called_pitches
from calledzone.plans.refresh import RefreshPaths, refresh_new
from calledzone.sources import sinks
from calledzone.sources.lake import TABLES, Lake
from calledzone.sources.published import Versions
from calledzone.sources.tables import GameTables

# Fits that stop at once: what they are fitted on decides their weights all the same.
QUICK = {"umpire_options": {"rule": replace(fits.POOLED_RULE, threshold_floor=1e9, max_steps=2)},
         "batter_options": {"rule": replace(fits.BATTER_RULE, threshold_floor=1e9, max_steps=2, min_rows=8)}}


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def raw(tables, before="9999", since="0000"):
    """The tables as they come, games of some days only."""
    low, high = (f"gid_{day.replace('-', '_')}" for day in (since, before))
    name = F.col("gameName")
    return GameTables(**{n: getattr(tables, n).drop("game_date", "season", "month").where((name >= low) & (name < high)) for n in TABLES})


@pytest.fixture(scope="module")
def two_seasons(tables):
    """Raw tables of 1998 and 1999, as files, so that tests read them often."""
    kept = {}
    for n, df in vars(raw(tables, "2000-01-01", "1998-01-01")).items():
        if df is not None:
            kept[n] = df.cache()
    return GameTables(**kept)


def test_games_taken_in_by_batches_equal_all_at_once(spark, tables, two_seasons, tmp_path):
    whole, steps = Lake(spark, str(tmp_path / "whole")), Lake(spark, str(tmp_path / "steps"))
    first = whole.ingest(two_seasons)
    assert first.seasons == (1998, 1999) and first.version == 1
    names = sorted(r.gameName for r in two_seasons.games.where("gameName >= 'gid_1999'").collect())
    last, next_one = (n.removeprefix("gid_").replace("_", "-") for n in names[len(names) // 2:][:2])
    assert steps.ingest(raw(two_seasons, last)).seasons == (1998, 1999)
    one_day = steps.ingest(raw(two_seasons, next_one))
    assert one_day.seasons == (1999,) and one_day.games == 1
    assert steps.ingest(raw(two_seasons, next_one)).games == 0 and steps.version() == 2
    steps.ingest(two_seasons)
    for name in TABLES:
        assert rows_of(steps.table(name)) == rows_of(whole.table(name)), name
    assert rows_of(called_pitches(steps.tables(tables.zones))) == rows_of(called_pitches(two_seasons.with_zones(tables.zones)))
    # The day before the last batch can still be read, and a season is read from its folders alone.
    assert steps.table("games", 1).count() < steps.table("games", 2).count() < steps.table("games").count()
    files = steps.table("pitches", seasons=[1999]).inputFiles()
    assert files and all("season=1999" in file for file in files)
    assert steps.changed_seasons({1998: 1, 1999: 1}, 2) == [1999]
    assert steps.changed_seasons({}, 2) == [1998, 1999] and steps.changed_seasons({1998: 2, 1999: 2}, 2) == []


def test_an_ingest_cut_short_leaves_no_rows(spark, two_seasons, tmp_path, monkeypatch):
    """The driver is lost after the pitches are written and before the manifest: nothing is seen, and nothing is there twice."""
    lake = Lake(spark, str(tmp_path / "lake"))

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(lake.versions, "publish", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            lake.ingest(two_seasons)
    assert lake.version() is None and lake.table("pitches").count() == 0
    lake.ingest(two_seasons)
    assert lake.table("pitches").count() == two_seasons.pitches.count()


def test_repeated_rows_and_bad_names(spark, two_seasons, tmp_path):
    bad = spark.createDataFrame([("x", "R"), (None, "R")], "gameName string, type string")
    games = two_seasons.games.unionByName(two_seasons.games).unionByName(bad)
    lake = Lake(spark, str(tmp_path / "lake"))
    got = lake.ingest(replace(two_seasons, games=games))
    assert got.games == two_seasons.games.count() == lake.table("games").count()
    empty = GameTables(**{n: getattr(two_seasons, n).limit(0) for n in TABLES})
    assert lake.ingest(empty).games == 0


def test_only_touched_seasons_are_refreshed(spark, tables, two_seasons, tmp_path):
    def setting(name):
        store = sinks.ModelStore(spark, str(tmp_path / name / "store"))
        paths = RefreshPaths(*[str(tmp_path / name / k) for k in ("zones", "ucs", "reports")])
        sinks.write_batter_zones(tables.zones, sinks.zones_table(spark, paths.zones))
        return Lake(spark, str(tmp_path / name / "lake")), store, paths

    day, at = date(2020, 1, 2), datetime(2020, 1, 2, 3)
    lake, store, paths = setting("steps")
    first = lake.ingest(raw(two_seasons, "1999-12-01"))
    Versions(spark, f"{paths.reports}/_seasons").publish(lambda old: old, {"1998": first.version, "1999": first.version})
    assert refresh_new(raw(two_seasons, "1999-12-01"), lake, store, paths, day, at, **QUICK) == {}
    written = refresh_new(two_seasons, lake, store, paths, day, at, **QUICK)
    assert set(written) == {1999}
    assert refresh_new(two_seasons, lake, store, paths, day, at, **QUICK) == {}
    whole = setting("whole")
    assert set(refresh_new(raw(two_seasons, since="1999-01-01"), *whole, day, at, **QUICK)) == {1999}
    scores = [rows_of(sinks.scores_table(spark, p.ucs).read()) for p in (paths, whole[2])]
    assert scores[0] == scores[1] != []
    zones = [rows_of(sinks.zones_table(spark, p.zones).read()) for p in (paths, whole[2])]
    assert zones[0] == zones[1]
    assert sinks.report_path(spark, paths.reports, "results", day) == written[1999]["results"]
    assert rows_of(store.current()) == rows_of(whole[1].current())
