"""The comparison as one job: what it scored with is noted, and a run cut short goes on to the same rows."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from calledzone.operators import fits
from calledzone.operators.roc import long_scores, roc_auc
from calledzone.plans import comparison, evaluation
from calledzone.plans.comparison import Comparison, newest_run, newest_scores
from calledzone.sources import sample_models, sinks
from calledzone.sources.ledger import RunLedger


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def nets(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("nets"))
    run = Comparison(tables, sinks.ModelStore(spark, root), root, "nets", last_season=2001)
    fact = evaluation.scored_rows(run.judged)
    return sample_models.month_nets(tables, fact).unionByName(
        sample_models.month_nets(tables, fact, movement=True)).unionByName(
        sample_models.individual_nets(tables, fact, run.judged))


def begun(spark, tables, nets, root, run_id="one"):
    store = sinks.ModelStore(spark, f"{root}/store")
    if not store.version():
        store.save(nets)
    run = Comparison(tables, store, root, run_id, last_season=1998, after_season=1994)
    run.fit_buckets()
    return run


def test_steps_are_done_once(spark, tmp_path):
    ledger, calls = RunLedger(spark, str(tmp_path / "steps")), []
    for _ in range(2):
        assert ledger.step("a", lambda: calls.append(1) or {"x": 1}) == {"x": 1}
    assert calls == [1] and ledger.done() == ["a"]
    with pytest.raises(ZeroDivisionError):
        ledger.step("b", lambda: 1 // 0)
    assert ledger.done() == ["a"] and RunLedger(spark, str(tmp_path / "steps")).result("a") == {"x": 1}


def test_a_run_cut_short_goes_on_to_the_same_rows(spark, tables, nets, tmp_path, monkeypatch):
    whole = begun(spark, tables, nets, str(tmp_path / "whole"))
    want, areas = rows_of(whole.scores()), rows_of(whole.areas())
    assert want and len(areas) == 4

    root = str(tmp_path / "cut")
    run, plain, seen = begun(spark, tables, nets, root), comparison.compare_models, []

    def lost_in_the_third(*args, **options):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("driver lost")
        return plain(*args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(comparison, "compare_models", lost_in_the_third)
        with pytest.raises(RuntimeError, match="driver lost"):
            run.areas()
    assert [s for s in run.ledger.done() if s.startswith("scores-")] == ["scores-1995-1995", "scores-1996-1996"]
    assert newest_run(spark, root) == {}
    # Meanwhile every net goes, and buckets change.
    run.store.remove(run.store.current())
    run.store.compact()
    run.store.save_buckets(run.store.buckets().withColumn("ratio", F.lit(0.5)))
    with monkeypatch.context() as patch:
        patch.setattr(comparison, "compare_models", lost_in_the_third)
        later = begun(spark, tables, nets, root)
        assert rows_of(later.areas()) == areas
    assert len(seen) == 3 + 2
    assert rows_of(later.scores()) == want == rows_of(newest_scores(spark, root))
    assert newest_run(spark, root) == {"run": "one", "models": 1, "buckets": 1}
    # A new run sees what the store holds now.
    other = begun(spark, tables, nets, root, "two")
    assert other.scores().where("nn_gen <> -999").count() == 0
    assert newest_run(spark, root)["run"] == "one"


def test_a_run_keeps_its_settings(spark, tables, nets, tmp_path):
    run = begun(spark, tables, nets, str(tmp_path))
    with pytest.raises(ValueError, match="was begun with"):
        Comparison(tables, run.store, str(tmp_path), "one", last_season=1999)


def test_areas_are_those_of_the_scores(spark, tables, nets, tmp_path):
    run = begun(spark, tables, nets, str(tmp_path))
    got = {r.model: r.auc for r in run.areas().collect()}
    again = roc_auc(long_scores(run.dataset(), evaluation.COMPARED)).collect()
    assert got == {r.model: pytest.approx(r.auc) for r in again}


def test_fits_to_areas(spark, tables, tmp_path):
    """Real season nets, fitted with a loose threshold on the few pitches there are, stored, read back and scored: better than chance."""
    store = sinks.ModelStore(spark, str(tmp_path / "store"))
    run = Comparison(tables, store, str(tmp_path), "fit", last_season=1996, after_season=1994, by_season=True, individual=False)
    run.fit(rule=replace(fits.POOLED_RULE, threshold_floor=0.5, max_steps=150))
    nets = store.current()
    assert nets.groupBy("kind").count().count() == 2 and nets.where("status = 'ok'").count() > nets.count() / 2
    areas = {r.model: r for r in run.areas().collect()}
    assert set(areas) == set(evaluation.COMPARED)
    assert all(r.strikes > 0 and r.balls > 0 for r in areas.values())
    assert areas["nn_gen"].auc > 0.7 and areas["naive"].auc > 0.7
    # Nothing is fitted or scored twice.
    before = store.version()
    run.fit()
    assert store.version() == before


def test_nets_of_umpires_add_each_pitch_up_once(spark, tables, monkeypatch):
    """Year-to-date windows take running totals; they are those of the pitches opened window by window."""
    from calledzone.operators.windows import assign_windows
    from calledzone.plans import training

    fact = evaluation.evaluation_fact(tables)
    tasks = training.individual_tasks(tables, last_season=9999)
    rows = assign_windows(fact, tasks.withColumn("umpire", F.col("entity_id")), ("umpire", "stand"))
    opened = rows.groupBy("model_key").agg(F.count("*"), F.sum("c"), F.expr("sum(CASE WHEN c = 1 THEN floor(px * 1000D) END)"))
    want = {key: (n, float(s) * (n - s) / n / 2, x / s / 1000 if s else None) for key, n, s, x in opened.collect()}
    monkeypatch.setattr(sample_models, "assign_windows", None)
    nets = sample_models.individual_nets(tables, fact).collect()
    assert {r.model_key for r in nets} == set(want) and len(nets) == len(want) > 0
    for r in nets:
        n, sse, centre = want[r.model_key]
        assert (r.n_train, r.sse) == (n, sse)
        assert r.w_hidden is None or r.w_hidden[0][0] == pytest.approx(6 * (0.85 - centre))


def test_weights_leave_a_row_with_its_score(spark):
    from calledzone.functions import net
    from calledzone.operators.scoring import with_net_score

    rows = spark.createDataFrame([("L", 0.0), ("R", 0.0)], "stand string, px double")
    nets = spark.createDataFrame([("L", [[0.0, 1.0]], [1.0, 2.0])], "stand string, w_hidden array<array<double>>, w_out array<double>")
    weights = nets.select("stand", *[c.alias(name) for name, c in net.weight_columns(1, "gen_").items()])
    scored = with_net_score(rows, weights, ["stand"], ["px"], "gen_")
    assert scored.columns == ["stand", "px", "gen_p"]
    assert {r.stand: r.gen_p for r in scored.collect()} == {"L": pytest.approx(0.880797, abs=1e-6), "R": None}
