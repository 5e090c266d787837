"""The registered queries: every operator run over the given tables."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import net
from calledzone.operators import buckets as B
from calledzone.operators import calendars as C
from calledzone.operators import fits
from calledzone.operators import grids as G
from calledzone.operators import models as M
from calledzone.operators import pitches as Q
from calledzone.operators import windows as W
from calledzone.operators.scoring import roc_dataset
from calledzone.plans import evaluation as E
from calledzone.plans import repair as R
from calledzone.plans import training as T
from calledzone.plans import zones as Z
from calledzone.plans.comparison import Comparison
from calledzone.session import materialise, run_folder, small_side
from calledzone.sources import sample, sample_models
from calledzone.sources.bucketed import bucket_tables, open_bucketed
from calledzone.sources.lake import TABLES, Lake
from calledzone.sources.sinks import ModelStore
from calledzone.sources.tables import GameTables, with_calendar

FIRST, LAST = 1995, 2001
RECENT_PITCHES = 150
BATTER_ROWS = 10
POOLED_BATTER_ROWS = 500
KEY = ("model_key", "kind", "span", "entity", "season", "d_s", "d_e", "stand")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_entity(models: DataFrame) -> DataFrame:
    """Entity ids as text, pooled models as 'generic'."""
    entity = F.coalesce(F.col("entity_id").cast("string"), F.lit("generic"))
    return models.withColumn("entity", entity)


def scored_fact(tables: GameTables) -> DataFrame:
    return E.evaluation_fact(tables)


def _written(spark, root) -> GameTables:
    """Game tables whose pitches are written once: numbering and dating them takes two shuffles of all lines a reader."""
    tables = sample.load(spark, root)
    return replace(tables, pitches=materialise(tables.pitches))


def called_pitches(spark, root):
    return _training_pitches(sample.load(spark, root))


def game_calendar(spark, root):
    """Dates read out of the game names themselves."""
    names = sample.load(spark, root).games.select("gameName", "type")
    return with_calendar(names)


def umpire_eval_list(spark, root):
    return Q.umpire_seasons(sample.load(spark, root), FIRST, LAST)


def umpire_eval_list_monthly(spark, root):
    return Q.umpire_months(sample.load(spark, root), last_season=LAST - 1)


def umpire_roc_list_monthly(spark, root):
    return Q.umpire_months(sample.load(spark, root), last_season=LAST, after_month=4)


def batter_list(spark, root):
    return Q.batter_seasons(sample.load(spark, root).atbats, after_season=FIRST)


def batter_main_hand(spark, root):
    return Q.main_hands(sample.load(spark, root).atbats)


def batter_training_set(spark, root):
    """Called pitches of batter-seasons that have enough of them."""
    fact = T.batter_training_fact(sample.load(spark, root))
    enough = fact.groupBy("batter", "season").agg(F.count("*").alias("n")).where(
        F.col("n") >= BATTER_ROWS
    )
    kept = fact.join(enough.select("batter", "season"), ["batter", "season"], "left_semi")
    return kept.select(
        "batter", "season", F.col("pitch_id").alias("gamedayPitchID"), F.round("px", 6).alias("px"),
        F.round("pz", 6).alias("pz"), "c",
    )


def batter_generic_training_set(spark, root):
    tables = sample.load(spark, root)
    fact = materialise(T.batter_training_fact(tables))
    tasks = T.batter_pooled_tasks(tables.atbats, after_season=0)
    rows = T.training_rows(fact, tasks, T.BATTERS_POOLED, limit=POOLED_BATTER_ROWS)
    return rows.select(
        "season", "stand", F.col("pitch_id").alias("gamedayPitchID"),
        F.round("px", 6).alias("px"), F.round("pz", 6).alias("pz"), "c",
    )


def generic_sz_scale(spark, root):
    return rounded(Q.zone_scale(sample.load(spark, root)), 8, "top", "bot", "height")


def season_range(spark, root):
    return Q.season_range(sample.load(spark, root).games)


def _seasons(spark, root):
    return Q.season_range(sample.load(spark, root).games)


def month_windows(spark, root):
    windows = C.per_hand(C.month_windows(_seasons(spark, root)))
    return windows.withColumn("last_day", C.last_day_of_month(F.col("d_s")))


def day_windows(spark, root):
    return C.per_hand(C.day_windows(_seasons(spark, root)))


def year_windows(spark, root):
    return C.per_hand(C.year_windows(_seasons(spark, root))).drop("month")


def ytd_windows(spark, root):
    return T.individual_tasks(sample.load(spark, root), last_season=LAST)


def _ytd_pooled(tables: GameTables) -> DataFrame:
    months = C.month_windows(Q.season_range(tables.games)).select("season", "month")
    return C.as_tasks(C.per_hand(C.year_to_date(months)), S.UMPIRE_GENERIC)


def window_assignment(spark, root):
    """Year-to-date windows: a pitch lies in as many as there are months left."""
    tables = sample.load(spark, root)
    rows = W.assign_windows(scored_fact(tables), _ytd_pooled(tables), ("stand",))
    return rows.groupBy("model_key").agg(
        F.count("*").alias("n"), F.sum("c").alias("strikes"),
        F.min("pitch_id").alias("first_id"), F.max("pitch_id").alias("last_id"),
    )


def recent_n_per_window(spark, root):
    tables = sample.load(spark, root)
    fact = materialise(scored_fact(tables).select("pitch_id", "game_date", "stand", "c"))
    rows = W.latest_per_window(fact, T.monthly_tasks(tables.games), ("stand",), RECENT_PITCHES)
    return rows.select("model_key", F.col("pitch_id").alias("gamedayPitchID"), "game_date", "c")


def _season_buckets(tables: GameTables) -> DataFrame:
    return B.bucket_models(scored_fact(tables), T.yearly_tasks(tables.games))


def bucket_model(spark, root):
    return _season_buckets(sample.load(spark, root)).select(
        "season", "d_s", "d_e", "stand", "grid_x", "grid_z", "n", "s", "ratio"
    )


def bucket_area(spark, root):
    tables = sample.load(spark, root)
    return Z.season_bucket_area(scored_fact(tables), tables.games)


def bucket_score(spark, root):
    """Pitches scored by the year-to-date buckets that ended the month before."""
    tables = sample.load(spark, root)
    fact = materialise(
        scored_fact(tables).select("pitch_id", "game_date", "stand", "px", "pz", "c")
    )
    models = B.bucket_models(fact, _ytd_pooled(tables)).withColumn(
        "model_day", C.model_month(F.col("d_e"))
    )
    rows = fact.withColumn("model_day", C.previous_month(F.col("game_date")))
    scored = B.bucket_score(rows, materialise(models), ["model_day", "stand"])
    return scored.select(
        F.col("pitch_id").alias("gamedayPitchID"), "stand", "grid_x", "grid_z",
        F.round("roeg", 6).alias("roeg"), "c",
    )


def nn_score(spark, root):
    scores = _ucs(spark, root)
    return rounded(scores.select("gamedayPitchID", "stand", "p"), 6, "p")


def nn_score_movement(spark, root):
    """Month nets with movement, on the pitches of their own month."""
    tables = sample.load(spark, root)
    columns = ("pitch_id", "game_date", "stand", "c", *S.MOVEMENT_FEATURES)
    fact = materialise(scored_fact(tables).select(*columns))
    models = sample_models.month_nets(tables, fact, movement=True)
    month_day = C.model_month(F.col("d_e")).alias("month_day")
    lookup = M.lookup_weights(models, len(S.MOVEMENT_FEATURES), month_day, "stand")
    rows = fact.withColumn("month_day", F.trunc("game_date", "MM").cast("date"))
    rows = rows.join(small_side(lookup), ["month_day", "stand"])
    p = net.net_score(S.MOVEMENT_FEATURES)
    return rows.select(
        F.col("pitch_id").alias("gamedayPitchID"), "stand", F.round(p, 6).alias("p")
    )


def _ucs(spark, root) -> DataFrame:
    tables = sample.load(spark, root)
    columns = ("pitch_id", "umpire", "game_date", "season", "stand", "c", *S.ZONE_FEATURES)
    fact = materialise(scored_fact(tables).select(*columns))
    return E.season_scores(fact, sample_models.season_nets(tables, fact))


def umpire_ucs(spark, root):
    return rounded(_ucs(spark, root), 6, "p", "ucs")


def umpire_uzr(spark, root):
    """Extra strikes per named umpire, season and hand."""
    umpires = sample.load(spark, root).umpires
    report = E.extra_strikes_by_umpire(_ucs(spark, root), umpires, FIRST, LAST)
    return rounded(rounded(report, 4, "p", "x"), 6, "x_over_n")


def umpire_uzr_year(spark, root):
    report = E.extra_strikes_by_season(_ucs(spark, root), FIRST, LAST)
    return rounded(rounded(report, 4, "p", "x"), 6, "x_over_n")


def _batter_nets(tables: GameTables) -> DataFrame:
    columns = ("batter", "season", "game_date", "stand", "c", *S.BATTER_FEATURES)
    fact = materialise(T.batter_training_fact(tables).select(*columns))
    return sample_models.batter_nets(tables, fact)


def batter_zone(spark, root):
    tables = sample.load(spark, root)
    return Z.batter_zones(tables.atbats, _batter_nets(tables), after_season=0)


def batter_model_choice(spark, root):
    """Which net speaks for each batter-season: its own, or its hand's."""
    tables = sample.load(spark, root)
    nets = M.usable_models(_batter_nets(tables)).withColumn("pick", F.struct("model_key", "n_train"))
    own = M.of_kind(nets, S.BATTER).select(
        F.col("entity_id").alias("id"), F.col("season").alias("year"), "pick"
    )
    pooled = M.of_kind(nets, S.BATTER_GENERIC).select(F.col("season").alias("year"), "stand", "pick")
    chosen = M.with_fallback(
        Q.batter_seasons(tables.atbats, 0), Q.main_hands(tables.atbats), own, pooled
    )
    return chosen.select("id", "year", "stand", "pick.model_key", F.coalesce("pick.n_train", F.lit(0)).alias("n_train"), "generic")


def batter_model_lookup(spark, root):
    """Own nets only; batters without one drop out."""
    tables = sample.load(spark, root)
    found = M.batter_model(_batter_nets(tables), Q.batter_seasons(tables.atbats, 0))
    return found.select("id", "year", "model_key", "n_train", "status")


def _zone_fact(tables: GameTables) -> DataFrame:
    columns = ("game_date", "stand", "c", "pz", *S.ZONE_FEATURES)
    return materialise(scored_fact(tables).select(*columns))


def nn_area(spark, root):
    tables = sample.load(spark, root)
    nets = sample_models.season_nets(tables, scored_fact(tables))
    return rounded(Z.net_area(tables, nets), 4, "area")


def area_report(spark, root):
    tables = sample.load(spark, root)
    fact = _zone_fact(tables)
    net_area = Z.net_area(tables, sample_models.season_nets(tables, fact))
    report = Z.area_report(net_area, Z.season_bucket_area(fact, tables.games))
    return rounded(report, 4, "my_area", "diff")


def _judged(tables: GameTables) -> DataFrame:
    """Every called pitch, written once for the lists, the nets and the scores of a comparison."""
    columns = ("pitch_id", "umpire", "game_date", "season", "month", "stand", "known_height", "has_zone", "c", "pz")
    return materialise(Q.judged_pitches(tables).select(*columns, *S.MOVEMENT_FEATURES))


def _comparison_nets(tables: GameTables, judged: DataFrame) -> DataFrame:
    fact = E.scored_rows(judged)
    return (
        sample_models.month_nets(tables, fact)
        .unionByName(sample_models.month_nets(tables, fact, movement=True))
        .unionByName(sample_models.individual_nets(tables, fact, judged))
    )


def _roc(tables: GameTables) -> DataFrame:
    """The comparison table, its fact written once because five models are made from it."""
    judged = _judged(tables)
    fact = E.scored_rows(judged)
    buckets = materialise(B.bucket_models(fact, T.monthly_tasks(tables.games)))
    listed = E.comparison_fact(tables, fact, last_season=LAST, judged=judged)
    return E.compare_models(listed, _comparison_nets(tables, judged), buckets)


def roc_scores(spark, root):
    scores = _roc(sample.load(spark, root))
    return rounded(scores, 6, "nn_ind", "nn_gen", "nn_pdata", "nn_regress", "roeg")


def _roc_data(spark, root) -> DataFrame:
    tables = _written(spark, root)
    scores = rounded(_roc(tables), 6, "nn_ind", "nn_gen", "nn_pdata", "nn_regress", "roeg")
    return roc_dataset(scores, tables.pitches, after_season=FIRST - 1)


def roc_data(spark, root):
    return _roc_data(spark, root)


def roc_curve(spark, root):
    return rounded(E.curves(_roc_data(spark, root)), 6, "tpr", "fpr")


def roc_auc(spark, root):
    return rounded(E.areas_under_curves(_roc_data(spark, root)), 6, "auc")


def _comparison(tables: GameTables, run_id: str = "run", **settings) -> Comparison:
    """A run of the comparison in a folder of its own."""
    folder = run_folder(tables.pitches.sparkSession, "comparison")
    store = ModelStore(tables.pitches.sparkSession, f"{folder}/store")
    return Comparison(tables, store, folder, run_id, last_season=LAST, after_season=FIRST - 1, digits=6, seasons_per_step=4, **settings)


def _stored_comparison(tables: GameTables) -> Comparison:
    run = _comparison(tables)
    run.store.save(_comparison_nets(tables, run.judged))
    run.fit_buckets()
    return run


def stored_comparison(spark, root):
    """Scores of nets and buckets read from the store in noted versions, a season at a time."""
    return _stored_comparison(sample.load(spark, root)).scores().drop("season")


def stored_auc(spark, root):
    """Areas published by a run whose nets and buckets come from the store."""
    return rounded(_stored_comparison(_written(spark, root)).areas(), 6, "auc")


def fitted_auc(spark, root):
    """From fits to areas: nets of all months fitted, stored, read back, scored and compared."""
    run = _comparison(_written(spark, root))
    run.fit()
    return rounded(run.areas(), 6, "auc")


def season_comparison(spark, root):
    """Season mode: pooled season nets and buckets on the pitches of their own season, no nets of single umpires."""
    tables = sample.load(spark, root)
    run = _comparison(tables, by_season=True, individual=False)
    fact = E.scored_rows(run.judged)
    run.store.save(sample_models.season_nets(tables, fact).unionByName(
        sample_models.season_nets(tables, fact, movement=True)))
    run.fit_buckets()
    return run.scores().drop("season")


# First days of the batches in which the sample's games arrive; the second one splits a season.
BATCHES = ("1996-01-01", "1998-07-15")
BUCKETS = 16


def _training_pitches(tables: GameTables) -> DataFrame:
    fact = T.umpire_training_fact(tables).select(
        F.col("pitch_id").alias("gamedayPitchID"), "umpire", "batter", "game_date", "season",
        "month", "stand", "px", "pz", "pfx_x", "pfx_z", "sz_mid", "pz_ratio", "c",
    )
    return rounded(fact, 6, "px", "pz", "pfx_x", "pfx_z", "sz_mid", "pz_ratio")


def bucketed_pitches(spark, root):
    """The called pitches of tables stored in buckets by at-bat, where pitches are joined without an exchange."""
    tables = sample.load(spark, root)
    folder = run_folder(spark, "bucketed")
    name = "pitching_" + folder.rpartition("-")[2]
    bucket_tables(tables, folder, name, BUCKETS)
    return _training_pitches(open_bucketed(spark, folder, name, BUCKETS, tables.zones))


def ingested_pitches(spark, root):
    """The called pitches of a lake that took its games in by three batches, the last two with games it had already."""
    tables = _written(spark, root)
    raw = {name: getattr(tables, name).drop("game_date", "season", "month") for name in TABLES}
    lake = Lake(spark, run_folder(spark, "lake"))
    for end in (*BATCHES, "9999-12-31"):
        name = f"gid_{end.replace('-', '_')}"
        lake.ingest(GameTables(**{table: rows.where(F.col("gameName") < name) for table, rows in raw.items()}))
    return _training_pitches(lake.tables(tables.zones))


def bad_umpire_models(spark, root):
    tables = sample.load(spark, root)
    fact = scored_fact(tables)
    nets = sample_models.season_nets(tables, fact).unionByName(
        sample_models.individual_nets(tables, fact)
    )
    bad = with_entity(R.bad_umpire_models(nets))
    return rounded(bad, 6, "p_centre").select(*KEY, "status", "p_centre")


def bad_batter_models(spark, root):
    bad = with_entity(R.bad_batter_models(_batter_nets(sample.load(spark, root))))
    return rounded(bad, 6, "p_worst").select(*KEY, "status", "p_worst")


def heatmap_zone(spark, root):
    tables = sample.load(spark, root)
    nets = sample_models.season_nets(tables, scored_fact(tables))
    return rounded(G.over_grid(nets, G.AREA_GRID), 6, "p")


def heatmap_batter(spark, root):
    nets = _batter_nets(sample.load(spark, root))
    pooled = M.of_kind(nets, S.BATTER_GENERIC)
    return rounded(G.over_grid(pooled, G.BATTER_MAP_GRID), 6, "p")


def heatmap_bucket(spark, root):
    tables = sample.load(spark, root)
    return Z.bucket_map(_season_buckets(tables))


def heatmap_list(spark, root):
    """Maps of listed nets: each season's and hand's busiest month."""
    tables = sample.load(spark, root)
    nets = M.usable_models(sample_models.month_nets(tables, scored_fact(tables)))
    busiest = nets.groupBy("season", "stand").agg(
        F.max_by(F.struct("d_s", "d_e"), F.struct("n_train", "d_s")).alias("w")
    )
    wanted = busiest.select(
        F.lit("generic").alias("id"), F.col("w.d_s").alias("start"), F.col("w.d_e").alias("end"), "stand"
    )
    listed = wanted.unionByName(wanted)
    return rounded(G.over_grid(M.zone_model(nets, listed), G.AREA_GRID), 6, "p")


def model_edges(spark, root):
    tables = sample.load(spark, root)
    edges = M.model_edges(sample_models.season_nets(tables, scored_fact(tables)))
    return rounded(edges, 6, "weight", "sse")


def pending_models(spark, root):
    tables = sample.load(spark, root)
    stored = sample_models.month_nets(tables, scored_fact(tables))
    tasks = T.monthly_tasks(tables.games).unionByName(T.yearly_tasks(tables.games))
    return with_entity(M.pending(tasks, stored)).select(*KEY)


def _fit_report(fact: DataFrame, tasks: DataFrame, kind: T.Kind, min_rows: int | None = None) -> DataFrame:
    """Every task with what it was fitted on, and whether its training pitches, scored again, give the stored error."""
    rule = kind.rule if min_rows is None else replace(kind.rule, min_rows=min_rows)
    tasks = materialise(tasks)
    columns = {*kind.on, "game_date", "season", "pitch_id", "c", *kind.features}
    fact = materialise(fact.select(*sorted(columns)))
    models = materialise(T.train(fact, tasks, kind, rule=rule))
    weights = models.where("w_out IS NOT NULL").select(
        "model_key", *[c.alias(name) for name, c in net.weight_columns(len(kind.features)).items()]
    )
    points = fits.training_points(T.training_rows(fact, tasks, kind), kind.features)
    scored = points.join(weights, "model_key").withColumn("p", net.net_score(kind.features))
    again = scored.groupBy("model_key").agg(
        F.expr("sum(0.5D * (s * (1 - p) * (1 - p) + (n - s) * p * p))").alias("again")
    )
    return models.join(again, "model_key", "left").select(
        "model_key", "season", "d_s", "d_e", "stand", "n_train", "hidden",
        F.col("w_out").isNotNull().alias("fitted"),
        F.expr("again IS NULL OR abs(again - sse) <= 1e-6D * (1 + sse)").alias("same_error"),
    )


def fit_umpire_generic(spark, root):
    tables = sample.load(spark, root)
    return _fit_report(T.umpire_training_fact(tables), T.yearly_tasks(tables.games), T.POOLED)


def fit_umpire_individual(spark, root):
    tables = _written(spark, root)
    return _fit_report(
        T.umpire_training_fact(tables), T.individual_tasks(tables, LAST), T.INDIVIDUAL
    )


def fit_movement(spark, root):
    tables = sample.load(spark, root)
    tasks = T.monthly_tasks(tables.games, S.UMPIRE_MOVEMENT)
    return _fit_report(T.umpire_training_fact(tables), tasks, T.MOVEMENT)


def fit_batter(spark, root):
    tables = sample.load(spark, root)
    tasks = T.batter_tasks(tables.atbats, after_season=0)
    return _fit_report(T.batter_training_fact(tables), tasks, T.BATTERS, min_rows=BATTER_ROWS)


def fit_batter_generic(spark, root):
    tables = sample.load(spark, root)
    tasks = T.batter_pooled_tasks(tables.atbats, after_season=0)
    return _fit_report(T.batter_training_fact(tables), tasks, T.BATTERS_POOLED)


def repair_batter_models(spark, root):
    """Spoiled batter nets found and fitted again."""
    tables = _written(spark, root)
    bad = R.bad_batter_models(_batter_nets(tables)).where(F.col("kind") == S.BATTER)
    return _fit_report(
        T.batter_training_fact(tables), bad.select(*S.TASK.fieldNames()), T.BATTERS, min_rows=BATTER_ROWS)


def spring_training_set(spark, root):
    """Pitches umpire nets may be fitted on when spring games count as well."""
    fact = T.umpire_training_fact(sample.load(spark, root), incl_spring=True)
    return rounded(fact.select(
        F.col("pitch_id").alias("gamedayPitchID"), "umpire", "season", "month", "stand", "px", "pz_ratio", "c",
    ), 6, "px", "pz_ratio")


def both_hands_assignment(spark, root):
    """Month windows over all hands, key 'B', with the pitches that lie in them."""
    tables = sample.load(spark, root)
    tasks = C.as_tasks(C.month_windows(Q.season_range(tables.games)), S.UMPIRE_GENERIC)
    rows = W.assign_windows(T.umpire_training_fact(tables), tasks, ())
    return rows.groupBy("model_key").agg(
        F.count("*").alias("n"), F.sum("c").alias("strikes"),
        F.min("pitch_id").alias("first_id"), F.max("pitch_id").alias("last_id"),
    )


def bucket_model_whole_months(spark, root):
    """Month buckets whose windows take in their last day."""
    tables = sample.load(spark, root)
    windows = C.per_hand(C.month_windows(Q.season_range(tables.games), include_last_day=True))
    return B.bucket_models(scored_fact(tables), C.as_tasks(windows, S.UMPIRE_GENERIC)).select(
        "season", "d_s", "d_e", "stand", "grid_x", "grid_z", "n", "s", "ratio")


def repair_models(spark, root):
    """Spoiled umpire nets found and fitted again."""
    tables = _written(spark, root)
    bad = R.bad_umpire_models(sample_models.individual_nets(tables, scored_fact(tables)))
    tasks = bad.where(F.col("kind") == T.INDIVIDUAL.name).select(*S.TASK.fieldNames())
    return _fit_report(T.umpire_training_fact(tables), tasks, T.INDIVIDUAL)


QUERIES = (
    called_pitches, game_calendar, umpire_eval_list, umpire_eval_list_monthly, umpire_roc_list_monthly,
    batter_list, batter_main_hand, batter_training_set, batter_generic_training_set,
    generic_sz_scale, season_range, month_windows, day_windows, year_windows, ytd_windows,
    window_assignment, recent_n_per_window, bucket_model, bucket_area, bucket_score,
    nn_score, nn_score_movement, umpire_ucs, umpire_uzr, umpire_uzr_year,
    batter_zone, batter_model_choice, batter_model_lookup, nn_area, area_report,
    roc_scores, roc_data, roc_curve, roc_auc, bad_umpire_models, bad_batter_models,
    heatmap_zone, heatmap_batter, heatmap_bucket, heatmap_list, model_edges, pending_models,
    fit_umpire_generic, fit_umpire_individual, fit_movement, fit_batter, fit_batter_generic,
    repair_models, stored_comparison, stored_auc, season_comparison, fitted_auc, ingested_pitches,
    bucketed_pitches, repair_batter_models, spring_training_set, both_hands_assignment, bucket_model_whole_months,
)
