"""Pitches scored by stored models."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import net
from calledzone.functions import pitch as P
from calledzone.operators import calendars as C
from calledzone.operators.buckets import bucket_score
from calledzone.operators.models import lookup_weights, of_kind
from calledzone.session import small_side

def season_scores(fact: DataFrame, models: DataFrame) -> DataFrame:
    """Every pitch scored by its season's pooled model of the batter's hand, with the call's credit.

    Hands and seasons without a usable model drop out.
    """
    pooled = of_kind(models, S.UMPIRE_GENERIC, C.SEASON)
    weights = lookup_weights(pooled, len(S.ZONE_FEATURES), "season", "stand")
    scored = fact.join(small_side(weights), ["season", "stand"])
    scored = scored.withColumn("p", net.net_score(S.ZONE_FEATURES))
    return scored.select(
        F.col("pitch_id").alias("gamedayPitchID"),
        "umpire",
        F.col("game_date").alias("date"),
        "p",
        net.call_score(F.col("p"), F.col("c")).alias("ucs"),
        F.col("c").cast("short").alias("c"),
        "stand",
    )


def with_net_score(rows: DataFrame, weights: DataFrame, on: Sequence[str], features: Sequence[str], prefix: str) -> DataFrame:
    """Add `<prefix>p`, the score of the net that `weights` gives for `on`, or null.

    A net's weights leave the row before the next one's join it: rows stay narrow, and each score's code short enough
    to be compiled.
    """
    joined = rows.join(small_side(weights), [*on], "left")
    scored = joined.withColumn(f"{prefix}p", net.net_score(features, prefix))
    return scored.drop(*net.weight_columns(len(features), prefix))


def compare_models(
    fact: DataFrame,
    models: DataFrame,
    buckets: DataFrame,
    *,
    regress: float = S.REGRESS_PITCHES,
    by_season: bool = False,
    individual: bool = True,
) -> DataFrame:
    """Five scores per pitch, each from models of the month before the pitch.

    The umpire's own model falls back to the pooled one (then with weight n = 0),
    and a score no model can give is -999. With `by_season` the models of the
    pitch's own season are used instead.
    """
    if by_season:
        own_span = pooled_span = C.SEASON
        pitch_day = F.make_date("season", F.lit(1), F.lit(1))
        model_day = F.col("d_s")
    else:
        own_span, pooled_span = C.YEAR_TO_DATE, C.MONTH
        pitch_day = C.previous_month(F.col("game_date"))
        model_day = C.model_month(F.col("d_e"))

    def lookup(kind, span, features, prefix, *extra):
        keys = (model_day.alias("model_day"), "stand", *extra)
        return lookup_weights(of_kind(models, kind, span), len(features), *keys, prefix=prefix)

    pooled = lookup(S.UMPIRE_GENERIC, pooled_span, S.ZONE_FEATURES, "gen_")
    moving = lookup(S.UMPIRE_MOVEMENT, pooled_span, S.MOVEMENT_FEATURES, "pdata_")
    own = lookup(
        S.UMPIRE_INDIVIDUAL, own_span, S.ZONE_FEATURES, "own_",
        F.col("entity_id").alias("umpire"), F.col("n_train").alias("own_n"),
    )
    bucket_rows = buckets.where(F.col("span") == pooled_span).withColumn("model_day", model_day)
    with_buckets = bucket_rows.select("model_day", "stand", F.lit(True).alias("has_buckets")).distinct()

    key = ["model_day", "stand"]
    rows = fact.where(F.col("stand").isin(*S.HANDS)).withColumn("model_day", pitch_day)
    rows = with_net_score(rows, pooled, key, S.ZONE_FEATURES, "gen_")
    rows = with_net_score(rows, moving, key, S.MOVEMENT_FEATURES, "pdata_")
    rows = with_net_score(rows, own, [*key, "umpire"], S.ZONE_FEATURES, "own_")
    rows = rows.join(small_side(with_buckets), key, "left")
    rows = bucket_score(rows, bucket_rows, key)

    p_gen, p_pdata = F.col("gen_p"), F.col("pdata_p")
    p_own = F.col("own_p") if individual else F.lit(None).cast("double")
    n = F.when(p_own.isNotNull(), F.col("own_n")).otherwise(F.lit(0))
    p_ind = F.coalesce(p_own, p_gen)
    shrunk = net.shrink(p_ind, n, p_gen, F.lit(float(regress)))

    def published(score):
        return F.coalesce(score, F.lit(S.NO_SCORE))

    return rows.select(
        F.col("pitch_id").alias("gamedayPitchID"),
        "umpire",
        F.col("game_date").alias("date"),
        n.cast("long").alias("n"),
        published(p_ind).alias("nn_ind"),
        published(p_gen).alias("nn_gen"),
        published(p_pdata).alias("nn_pdata"),
        published(shrunk).alias("nn_regress"),
        published(F.when(F.col("has_buckets"), F.col("roeg"))).alias("roeg"),
        F.col("c").cast("short").alias("c"),
        "stand",
    )


def roc_dataset(
    roc: DataFrame, pitches: DataFrame, after_month: int = 4, after_season: int = 2007
) -> DataFrame:
    """Comparison rows every model could score, with the fixed-box rule added."""
    models = ("nn_ind", "nn_gen", "nn_pdata", "roeg")
    complete = roc.where((F.month("date") > after_month) & (F.year("date") > after_season))
    for name in models:
        complete = complete.where(F.col(name) != S.NO_SCORE)
    places = pitches.select("gamedayPitchID", "px", "pz")
    joined = complete.join(places, "gamedayPitchID")
    return joined.withColumn("naive", P.in_naive_box(F.col("px"), F.col("pz"))).drop("px", "pz")
