"""ROC curves and areas, exact for any number of distinct scores.

Equal scores are counted together first. The running totals over the rest are taken over ranges of the scores as they
are spread, so no task orders all scores of a model, nor all that crowd at one end of the scale.
"""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone.operators.running import with_running
from calledzone.session import small_side


def long_scores(scores: DataFrame, columns: Mapping[str, str], label: str = "c") -> DataFrame:
    """One row per pitch and score column: (model, score, c)."""
    pairs = ", ".join(f"'{model}', CAST(`{column}` AS DOUBLE)" for model, column in columns.items())
    return scores.selectExpr(f"stack({len(columns)}, {pairs}) AS (model, score)", f"{label} AS c")


def _running(long: DataFrame) -> DataFrame:
    grouped = long.groupBy("model", "score").agg(
        F.sum("c").alias("pos"), (F.count("*") - F.sum("c")).alias("neg")
    )
    points = with_running(grouped, ["model"], [F.desc("score")], {"tp": "pos", "fp": "neg"})
    totals = points.groupBy("model").agg(F.max("tp").alias("all_pos"), F.max("fp").alias("all_neg"))
    return points.join(small_side(totals), "model")


def roc_curve(long: DataFrame) -> DataFrame:
    """One point per distinct score: calls at or above it taken as strikes."""
    points = _running(long)
    return points.select(
        "model", "score",
        F.try_divide(F.col("tp").cast("double"), F.col("all_pos")).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.col("all_neg")).alias("fpr"),
    )


def roc_auc(long: DataFrame) -> DataFrame:
    """Area under each model's curve; tied scores count half."""
    points = _running(long)
    won = F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / F.lit(2.0))
    area = F.try_divide(F.sum(won), F.max(F.col("all_pos").cast("double") * F.col("all_neg")))
    return points.groupBy("model").agg(
        area.alias("auc"), F.max("all_pos").alias("strikes"), F.max("all_neg").alias("balls")
    )
