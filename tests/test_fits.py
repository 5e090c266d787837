import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calledzone.operators import fits
from calledzone.operators.placement import dealt_by_cost, slots_for
from calledzone.plans import training

RULE = replace(fits.BATTER_RULE, threshold_floor=0.5, max_steps=300, min_rows=50)
FEATURES = ("px", "pz")


@pytest.fixture(scope="module")
def points(spark):
    """Three models of different size, and one with too few pitches."""
    draw = np.random.default_rng(5)
    rows = []
    for key, size in (("a", 60), ("b", 900), ("c", 400), ("few", 20)):
        x, z = draw.normal(0, 1, size).round(2), draw.normal(2.5, 0.8, size).round(2)
        sure = 1 / (1 + np.exp(-(4 - 3 * abs(x) - 2 * abs(z - 2.6))))
        strikes = draw.random(size) < sure
        rows += [(key, float(a), float(b), int(c)) for a, b, c in zip(x, z, strikes)]
    pitches = spark.createDataFrame(rows, "model_key string, px double, pz double, c int")
    return fits.training_points(pitches, FEATURES)


def fitted(points, **options):
    return {r.model_key: r for r in fits.fit_nets(points, FEATURES, options.pop("rule", RULE), **options).collect()}


def test_one_good_row_per_model(points):
    rows = fitted(points, most_points=1000)
    assert set(rows) == {"a", "b", "c"}
    totals = points.groupBy("model_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for r in totals.where("model_key <> 'few'").collect():
        row = rows[r.model_key]
        assert row.n_train == r.n
        assert math.isfinite(row.sse) and row.sse < r.s * (r.n - r.s) / r.n / 2
        assert len(row.w_hidden) == row.hidden == 4 and len(row.w_out) == 5
        assert row.status in ("ok", "not_converged")


def test_same_seed_same_weights(points):
    first, second = fitted(points, most_points=1000), fitted(points, most_points=1000)
    assert all(first[k].w_out == second[k].w_out for k in first)


def test_large_models_take_the_same_steps(points):
    rule = replace(RULE, max_steps=25)
    near, across = fitted(points, most_points=1000, rule=rule), fitted(points, task_points=100, rule=rule)
    assert set(near) == set(across)
    for key in near:
        assert near[key].steps == across[key].steps and near[key].status == across[key].status
        assert across[key].sse == pytest.approx(near[key].sse, rel=1e-6)


def test_large_models_converge_to_the_same_error(points):
    near, across = fitted(points, most_points=1000), fitted(points, task_points=100)
    assert set(near) == set(across)
    for key in near:
        assert near[key].status == across[key].status == "ok"
        assert across[key].sse == pytest.approx(near[key].sse, rel=1e-4)


def test_gradient_and_curvature_are_those_of_the_error():
    draw = np.random.default_rng(1)
    x = np.column_stack([np.ones(50), draw.normal(size=(50, 2))])
    n = draw.integers(1, 5, 50).astype(float)
    s = np.minimum(n, draw.integers(0, 5, 50)).astype(float)
    w = draw.normal(size=17)
    loss, gradient, curvature = fits.measure(w, 4, x, n, s)
    step = 1e-6
    for i in range(17):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        slope = (fits.measure(up, 4, x, n, s)[0] - fits.measure(down, 4, x, n, s)[0]) / (2 * step)
        assert gradient[i] == pytest.approx(slope, abs=1e-5)
    assert curvature == pytest.approx(curvature.T) and np.linalg.eigvalsh(curvature).min() > -1e-9
    parts = [fits.measure(w, 4, x[k], n[k], s[k]) for k in (slice(0, 20), slice(20, 50))]
    for whole, one, other in zip((loss, gradient, curvature), *parts):
        assert whole == pytest.approx(one + other)


@pytest.mark.parametrize("rule,rows,units", [
    (fits.INDIVIDUAL_RULE, 1500, 4), (fits.INDIVIDUAL_RULE, 1501, 5), (fits.POOLED_RULE, 10, 5),
    (fits.MOVEMENT_RULE, 10, 5), (fits.BATTER_RULE, 99_999, 4),
])
def test_hidden_units(rule, rows, units):
    assert rule.units(rows) == units


def test_stop_thresholds():
    assert fits.POOLED_RULE.threshold(1000) == 0.02
    assert fits.MOVEMENT_RULE.threshold(99_999) == pytest.approx(1.99998)


def test_batches_do_not_split_a_model(points, monkeypatch):
    pdf = points.where("model_key <> 'few'").toPandas().sort_values("model_key")
    whole = {r["model_key"]: r for r in fits._fit_block(pdf.sort_values(["model_key", *FEATURES]), FEATURES, RULE)}
    monkeypatch.setattr(fits, "BLOCK_POINTS", 100)
    parts = [pdf.iloc[i : i + 37] for i in range(0, len(pdf), 37)]
    rows = [r for out in fits._fit_partition(iter(parts), FEATURES, RULE) for r in out.to_dict("records")]
    assert sorted(r["model_key"] for r in rows) == ["a", "b", "c"]
    assert all(r["n_train"] == whole[r["model_key"]]["n_train"] for r in rows)
    assert all(r["sse"] == pytest.approx(whole[r["model_key"]]["sse"], rel=1e-6) for r in rows)


def test_weights_do_not_depend_on_placement(points):
    """Whatever the tasks, and whether a model fits one or is spread out: the same weights to the last bit."""
    rule = replace(RULE, max_steps=12)
    near = fitted(points, most_points=1000, rule=rule, sum_points=64)
    for other in (fitted(points.repartition(1), task_points=50, rule=rule, sum_points=64),
                  fitted(points.repartition(13, "px"), task_points=50, rule=rule, sum_points=64),
                  fitted(points.repartition(5), most_points=1000, rule=rule, sum_points=64)):
        assert set(near) == set(other)
        for key in near:
            assert (other[key].w_hidden, other[key].w_out, other[key].sse) == (near[key].w_hidden, near[key].w_out, near[key].sse)


def test_models_are_dealt_by_cost(spark, points):
    sizes = points.groupBy("model_key").agg(F.sum("n").alias("n"))
    assert set(fitted(points, most_points=1000, sizes=sizes)) == {"a", "b", "c"}
    draw = np.random.default_rng(3)
    costs = [(f"m{i:04}", int(c)) for i, c in enumerate(draw.pareto(1.5, 3000) * 100 + 1)]
    frame = spark.createDataFrame(costs, "model_key string, cost long")
    slots, number = dealt_by_cost(frame)
    of = {r.model_key: r.slot for r in slots.collect()}
    assert set(of) == {key for key, _ in costs} and number == slots_for(1, spark.sparkContext.defaultParallelism)
    load = np.bincount([of[key] for key, _ in costs], [c for _, c in costs], number)
    most = max(c for _, c in costs)
    assert load.max() <= load.mean() + most and np.median(load) > 0.5 * load.mean()
    assert dealt_by_cost(frame, task_cost=10_000)[1] == -(-sum(max(c, 1) for _, c in costs) // 10_000)


def test_a_fit_begins_again_until_it_ends_well():
    """The first start that ends well is kept; if none does, the one with the smallest error."""
    rule = replace(RULE, max_steps=1, starts=3, min_rows=1)
    descent, size = fits.Descent("m", 100, 2, rule), fits.weights_of(2, 4)
    steep, flat, curved = np.full(size, 9.0), np.zeros(size), np.eye(size)
    begun = [descent.w]
    for loss in (9.0, 8.0, 5.0, 4.0, 7.0, 6.0):
        descent.advance(loss, steep, curved)
        begun.append(descent.w)
    assert not descent.running and (descent.status, descent.sse, descent.start) == ("not_converged", 4.0, 2)
    assert not np.array_equal(begun[0], begun[2]) and not np.array_equal(begun[2], begun[4])
    again = fits.Descent("m", 100, 2, rule)
    assert np.array_equal(again.w, begun[0])
    for loss, gradient in ((9.0, steep), (8.0, steep), (5.0, steep), (4.5, flat)):
        again.advance(loss, gradient, curved)
    assert (again.status, again.sse, again.start) == ("ok", 4.5, 1)
    broken = fits.Descent("m", 100, 2, rule)
    for loss in (np.nan, np.inf, 3.0, 2.0):
        broken.advance(loss, steep, curved)
    assert (broken.status, broken.sse) == ("not_converged", 2.0)


def test_most_movement_nets_end_well(spark, tables):
    """By their full rule, on the fewest pitches there are."""
    tasks = training.monthly_tasks(tables.games, training.MOVEMENT.name)
    nets = training.train(training.umpire_training_fact(tables), tasks, training.MOVEMENT)
    found = {r.status: r["count"] for r in nets.groupBy("status").count().collect()}
    fitted = sum(n for status, n in found.items() if status != "too_few_rows")
    assert found["ok"] > 0.9 * fitted, found


def test_small_models_are_measured_together(monkeypatch):
    """Side by side every model takes the steps it takes alone, in a small part of the calls; slopes only for kept steps."""
    draw = np.random.default_rng(11)
    rows = []
    for model in range(300):
        x, z = draw.normal(0, 1, 12).round(2), draw.normal(2.5, 0.8, 12).round(2)
        rows += [(f"m{model:03}", a, b, 1, int(c)) for a, b, c in zip(x, z, (abs(x) < 0.8) ^ (draw.random(12) < 0.1))]
    pdf = pd.DataFrame(rows, columns=["model_key", *FEATURES, "n", "s"]).sort_values(["model_key", *FEATURES])
    rule = replace(RULE, max_steps=60, starts=2, min_rows=1)
    alone = [row for _, part in pdf.groupby("model_key") for row in fits._fit_block(part, FEATURES, rule)]
    models = {"loss": [], "slopes": []}
    loss, slopes = fits.Measured.__init__, fits.Measured.slopes
    monkeypatch.setattr(fits.Measured, "__init__", lambda self, w, *more: (models["loss"].append(len(w)), loss(self, w, *more))[1])
    monkeypatch.setattr(fits.Measured, "slopes", lambda self, which: (models["slopes"].append(which.sum()), slopes(self, which))[1])
    together = fits._fit_block(pdf, FEATURES, rule)
    assert sorted(together, key=lambda r: r["model_key"]) == alone
    assert len(models["loss"]) < sum(models["loss"]) / 20
    assert sum(models["slopes"]) < sum(models["loss"])
