import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from calledzone.operators import roc as R


def long(spark, pairs, model="m"):
    return spark.createDataFrame([(model, float(s), c) for s, c in pairs], "model string, score double, c int")


def auc(spark, pairs):
    (row,) = R.roc_auc(long(spark, pairs)).collect()
    return row.auc


def test_tied_scores_give_one_half(spark):
    assert auc(spark, [(0.3, i % 2) for i in range(10)]) == 0.5


def test_label_as_score_is_perfect(spark):
    assert auc(spark, [(i % 2, i % 2) for i in range(10)]) == 1.0


@pytest.mark.parametrize("digits", [2, 12])
def test_auc_matches_other_ways(spark, digits):
    draw = random.Random(digits)
    pairs = [(round(draw.betavariate(0.3, 0.5), digits), int(draw.random() < 0.4)) for _ in range(500)]
    pairs += [(-1.0, 0), (0.0, 1), (1.0, 1), (1e-9, 0)]
    strikes = [s for s, c in pairs if c]
    balls = [s for s, c in pairs if not c]
    won = sum((a > b) + (a == b) / 2 for a in strikes for b in balls) / len(strikes) / len(balls)
    rows = long(spark, pairs)
    assert auc(spark, pairs) == pytest.approx(won, abs=1e-12)
    other = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="c", numBins=0)
    assert auc(spark, pairs) == pytest.approx(other.evaluate(rows), abs=1e-9)


def test_curve_counts_calls_at_or_above(spark):
    points = R.roc_curve(long(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)])).collect()
    assert {p.score: (p.tpr, p.fpr) for p in points} == {0.9: (0.5, 0.0), 0.8: (1.0, 0.5), 0.1: (1.0, 1.0)}
