"""Umpire evaluation, extra-strike reports and the comparison of models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import net
from calledzone.operators import roc as R
from calledzone.operators.pitches import called_pitches, umpire_months
from calledzone.operators.scoring import compare_models, season_scores
from calledzone.session import materialise, small_side
from calledzone.sources.tables import GameTables, run_named

# Captions of the curves.
CAPTIONS = {
    "naive": "Naive model", "roeg": "Rates by bucket",
    "nn_gen": "Basic NN", "nn_pdata": "NN w/movement",
}
COMPARED = {name: name for name in ("naive", "roeg", "nn_gen", "nn_pdata")}


def evaluation_fact(tables: GameTables) -> DataFrame:
    """Pitches that are scored: a zone and a location, a batter's hand of L or R."""
    return called_pitches(tables, hands=S.HANDS)


def evaluate_umpires(tables: GameTables, models: DataFrame) -> DataFrame:
    """All umpires' pitches of all seasons scored in one pass."""
    return season_scores(evaluation_fact(tables), models)


def extra_strikes_by_umpire(
    ucs: DataFrame, umpires: DataFrame, first_season: int, last_season: int
) -> DataFrame:
    args = {"first_season": first_season, "last_season": last_season}
    return run_named(ucs.sparkSession, "extra_strikes_by_umpire", args, ucs=ucs, umpires=umpires)


def extra_strikes_by_season(ucs: DataFrame, first_season: int, last_season: int) -> DataFrame:
    args = {"first_season": first_season, "last_season": last_season}
    return run_named(ucs.sparkSession, "extra_strikes_by_season", args, ucs=ucs)


def scored_rows(judged: DataFrame) -> DataFrame:
    """The rows of `evaluation_fact` among those of `judged_pitches`."""
    return judged.where(F.col("has_zone") & F.col("stand").isin(*S.HANDS))


def comparison_fact(
    tables: GameTables, fact: DataFrame, last_season: int, after_month: int = 4, judged: DataFrame | None = None
) -> DataFrame:
    """Pitches of the umpire-months on the scoring list."""
    listed = umpire_months(tables, last_season, after_month, judged).select(
        F.col("id").alias("umpire"), F.col("year").alias("season"), "month"
    ).distinct()
    return fact.join(small_side(materialise(listed)), ["umpire", "season", "month"], "left_semi")


def compare(
    tables: GameTables, models: DataFrame, buckets: DataFrame, last_season: int, **options
) -> DataFrame:
    fact = comparison_fact(tables, evaluation_fact(tables), last_season)
    return compare_models(fact, models, buckets, **options)


def curves(dataset: DataFrame) -> DataFrame:
    return R.roc_curve(R.long_scores(dataset, COMPARED))


def areas_under_curves(dataset: DataFrame) -> DataFrame:
    auc = R.roc_auc(R.long_scores(dataset, COMPARED))
    label = F.coalesce(*[
        F.when(F.col("model") == model, net.rounded_label(caption, F.col("auc")))
        for model, caption in CAPTIONS.items()
    ])
    return auc.withColumn("label", label)
