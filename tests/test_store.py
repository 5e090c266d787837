"""Sinks, the model store, and the refresh as a whole."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.operators import fits
from calledzone.operators.models import pending
from calledzone.operators.pitches import called_pitches
from calledzone.plans import evaluation as E
from calledzone.plans import repair, training
from calledzone.plans.refresh import RefreshPaths, refresh
from calledzone.sources import sample_models, sinks
from calledzone.sources.tables import GameTables, ingest, read_model_list, read_tables

SEASON = 1998
UMPIRE_RULE = replace(fits.POOLED_RULE, threshold_floor=1.0, max_steps=400)
BATTER_RULE = replace(fits.BATTER_RULE, threshold_floor=0.8, max_steps=200, min_rows=8)


@pytest.fixture(scope="module")
def nets(tables):
    return sample_models.season_nets(tables, E.evaluation_fact(tables))


@pytest.fixture(scope="module")
def ucs(tables, nets):
    return E.evaluate_umpires(tables, nets)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_scores_have_the_published_schema(ucs):
    assert [(f.name, f.dataType) for f in ucs.schema] == [(f.name, f.dataType) for f in S.UMPIRE_UCS]


def test_writing_scores_twice_changes_nothing(spark, ucs, tmp_path):
    path = str(tmp_path / "ucs")
    sinks.write_umpire_ucs(ucs, path)
    first = rows(spark.read.parquet(path))
    sinks.write_umpire_ucs(ucs.where(F.year("date") == SEASON), path)
    assert rows(spark.read.parquet(path)) == first
    assert len(first) == ucs.count()


def test_comparison_table_is_replaced_or_added_to(spark, ucs, tmp_path):
    path = str(tmp_path / "roc")
    scores = ucs.limit(50).select(
        "gamedayPitchID", "umpire", "date", F.lit(0).cast("long").alias("n"),
        *[F.col("p").alias(c) for c in ("nn_ind", "nn_gen", "nn_pdata", "nn_regress", "roeg")], "c", "stand",
    )
    sinks.replace_umpire_roc(scores, path)
    sinks.replace_umpire_roc(scores, path)
    assert spark.read.parquet(path).count() == 50
    sinks.append_umpire_roc(scores, path)
    assert spark.read.parquet(path).count() == 100


def test_store_keeps_the_newest_model(spark, nets, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path))
    assert store.current().count() == 0
    store.save(nets)
    total = nets.count()
    spoiled = nets.where(F.col("season") == SEASON)
    store.save(spoiled.withColumn("status", F.lit("error")))
    assert store.current().count() == total
    assert store.current().where("status = 'error'").count() == spoiled.count()
    backup = store.backup(SEASON, (S.UMPIRE_GENERIC,), datetime(2020, 1, 2, 3, 4, 5))
    assert backup.endswith("snapshot_ts=20200102.030405")
    assert spark.read.parquet(backup).count() == spoiled.count()
    store.remove_season(SEASON, (S.UMPIRE_GENERIC,))
    assert store.current().count() == total - spoiled.count()
    store.save(spoiled)
    assert rows(store.current()) == rows(nets)


def test_stored_models_are_not_fitted_again(spark, tables, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path))
    options = dict(rule=replace(UMPIRE_RULE, max_steps=5))
    training.batch_yearly(store, tables, [SEASON], **options)
    versions = spark.read.parquet(store.path).select("version").distinct()
    assert versions.count() == 1
    training.batch_yearly(store, tables, [SEASON], overwrite=False, **options)
    assert versions.sparkSession.read.parquet(store.path).count() == 2
    training.batch_yearly(store, tables, [SEASON], **options)
    assert spark.read.parquet(store.path).count() == 4
    assert store.current().count() == 2


def test_spoiled_models_are_repaired(spark, tables, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path))
    training.batch_yearly(store, tables, [SEASON], rule=replace(UMPIRE_RULE, max_steps=2))
    assert repair.bad_umpire_models(store.current()).count() == 2
    assert repair.repair_umpires(store, tables, rule=UMPIRE_RULE) == 2
    assert store.current().where("status = 'ok'").count() == 2


def test_individual_and_daily_batches(spark, tables, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path))
    quick = replace(UMPIRE_RULE, max_steps=3)
    training.batch_individual(store, tables, 2001, rule=quick)
    training.batch_monthly(store, tables, rule=quick)
    training.batch_daily(store, tables, rule=quick)
    counts = {(r.kind, r.span): r["count"] for r in store.current().groupBy("kind", "span").count().collect()}
    listed = training.individual_tasks(tables, 2001).count()
    assert counts[(S.UMPIRE_INDIVIDUAL, "ytd")] == listed
    assert counts[(S.UMPIRE_MOVEMENT, "month")] == training.monthly_tasks(tables.games).count()
    assert counts[(S.UMPIRE_GENERIC, "day")] == training.daily_tasks(tables.games).count()


def test_buckets_are_stored_by_season(spark, tables, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path))
    fact = E.evaluation_fact(tables)
    training.train_and_save_buckets(store, fact, tables.games)
    first = rows(store.buckets())
    training.train_and_save_buckets(store, fact, tables.games)
    assert rows(store.buckets()) == first and first


def test_model_list_file(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("generic 2015-01-01 2015-12-31 R\n427 2015-01-01 2015-05-30 L\n" * 2)
    found = {(r.id, r.start, r.stand) for r in read_model_list(spark, str(path)).collect()}
    assert found == {("generic", date(2015, 1, 1), "R"), ("427", date(2015, 1, 1), "L")}


def test_ingested_tables_give_the_same_pitches(spark, tables, tmp_path):
    raw = {name: getattr(tables, name) for name in ("games", "umpires", "atbats", "pitches")}
    for name, df in raw.items():
        df.drop("game_date", "season", "month").write.parquet(str(tmp_path / "raw" / name))
    loaded = read_tables(spark, str(tmp_path / "raw"))
    stored = ingest(loaded, str(tmp_path / "stored")).with_zones(tables.zones)
    expected = rows(called_pitches(tables))
    assert rows(called_pitches(loaded.with_zones(tables.zones))) == expected
    assert rows(called_pitches(stored)) == expected


def test_pitches_do_not_fan_out(spark, tables):
    """A second, non-home umpire per game and a bad game name change nothing."""
    others = tables.umpires.withColumn("position", F.lit("first"))
    bad = spark.createDataFrame([("x", "R")], "gameName string, type string")
    games = tables.games.select("gameName", "type").unionByName(bad)
    wider = GameTables(games, tables.umpires.unionByName(others), tables.atbats, tables.pitches, tables.zones)
    fact = called_pitches(wider)
    count, distinct = fact.agg(F.count("*"), F.countDistinct("pitch_id")).first()
    assert count == distinct == called_pitches(tables).count() > 0


def test_umpire_and_season_reports_agree(tables, ucs):
    named = tables.umpires.withColumn("name", F.lit("somebody"))
    by_umpire = E.extra_strikes_by_umpire(ucs, named, 1995, 2001)
    by_season = E.extra_strikes_by_season(ucs, 1995, 2001)
    summed = by_umpire.groupBy("year", "stand").agg(F.sum("n").alias("n"), F.sum("cs").alias("cs"), F.sum("x").alias("x"))
    pairs = summed.alias("a").join(by_season.alias("b"), ["year", "stand"]).select("a.*", F.col("b.n").alias("bn"), F.col("b.cs").alias("bcs"), F.col("b.x").alias("bx")).collect()
    assert len(pairs) == by_season.count()
    for r in pairs:
        assert (r.n, r.cs) == (r.bn, r.bcs) and r.x == pytest.approx(r.bx, abs=1e-6)


def test_refresh_runs_and_can_be_repeated(spark, tables, tmp_path):
    store = sinks.ModelStore(spark, str(tmp_path / "store"))
    paths = RefreshPaths(*[str(tmp_path / name) for name in ("zones", "ucs", "reports")])
    results = []
    for hour in (1, 2):
        written = refresh(
            tables, store, paths, SEASON, date(2020, 1, 2), datetime(2020, 1, 2, hour),
            umpire_options={"rule": UMPIRE_RULE}, batter_options={"rule": BATTER_RULE},
        )
        assert set(written) == {"sz_area", "results", "results_tot"}
        results.append({name: sorted(r.value for r in spark.read.text(path).collect()) for name, path in written.items()})
    assert results[0] == results[1]
    header = [line for line in results[0]["sz_area"] if line.startswith("year")]
    assert header == ["year stand my_area roegele_area diff"]
    zones = spark.read.parquet(paths.zones)
    assert zones.where("year < 1998").count() == 0 and zones.where("sz_top > sz_bot").count() > 0
    assert spark.read.parquet(paths.ucs).select("season").distinct().count() == 1


def test_a_season_filter_skips_other_seasons(spark, tables, tmp_path):
    stored = ingest(tables, str(tmp_path)).with_zones(tables.zones)
    one = called_pitches(stored).where(F.col("season") == SEASON)
    plan = one._jdf.queryExecution().executedPlan().toString()
    pitches = [line for line in plan.splitlines() if "FileScan" in line and "gamedayPitchID" in line]
    assert pitches and all(f"= {SEASON})" in p.split("PartitionFilters")[1] for p in pitches)


def test_only_usable_batter_nets_count_as_stored(spark):
    tasks = spark.createDataFrame([("a", S.BATTER), ("b", S.BATTER), ("u", S.UMPIRE_GENERIC)], "model_key string, kind string")
    stored = spark.createDataFrame(
        [("a", S.BATTER, "too_few_rows"), ("b", S.BATTER, "ok"), ("u", S.UMPIRE_GENERIC, "not_converged")],
        "model_key string, kind string, status string")
    assert [r.model_key for r in pending(tasks, stored).collect()] == ["a"]


def test_zones_of_other_seasons_stay(spark, tmp_path):
    path = str(tmp_path / "zones")
    row = "batter int, year int, sz_top double, sz_bot double, generic int"
    for year, top in ((1996, 3.0), (1998, 3.1), (1998, 3.2)):
        sinks.write_batter_zones(spark.createDataFrame([(7, year, top, 1.5, 0)], row), path)
    assert sorted((r.year, r.sz_top) for r in spark.read.parquet(path).collect()) == [(1996, 3.0), (1998, 3.2)]
