"""Find models that fail their health check, drop them and fit them again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.operators.models import batter_health, failing, umpire_health
from calledzone.plans import training
from calledzone.session import materialise
from calledzone.sources.sinks import ModelStore
from calledzone.sources.tables import GameTables

UMPIRE_KINDS = (training.POOLED, training.MOVEMENT, training.INDIVIDUAL)
BATTER_KINDS = (training.BATTERS, training.BATTERS_POOLED)


def bad_umpire_models(models: DataFrame) -> DataFrame:
    names = [kind.name for kind in UMPIRE_KINDS]
    return failing(umpire_health(models.where(F.col("kind").isin(*names))))


def bad_batter_models(models: DataFrame) -> DataFrame:
    names = [kind.name for kind in BATTER_KINDS]
    return failing(batter_health(models.where(F.col("kind").isin(*names))))


def refit(bad: DataFrame, fact: DataFrame, kind: training.Kind, **options) -> DataFrame:
    """New rows for failing models of one kind, from the same windows."""
    tasks = bad.where(F.col("kind") == kind.name).select(*S.TASK.fieldNames())
    return training.train(fact, tasks, kind, **options)


def repair(store: ModelStore, bad: DataFrame, fact: DataFrame, kinds, **options) -> int:
    """Remove and refit the failing models of `kinds`; returns how many there were."""
    bad = materialise(bad)
    found = {row["kind"]: row["count"] for row in bad.groupBy("kind").count().collect()}
    for kind in kinds:
        if kind.name in found:
            store.remove(bad.where(F.col("kind") == kind.name))
            store.save(refit(bad, fact, kind, **options))
    return sum(found.values())


def repair_umpires(store: ModelStore, tables: GameTables, **options) -> int:
    """Umpires with too few pitches never had a model, so there is none to repair."""
    bad = bad_umpire_models(store.current()).where(F.col("status") != "too_few_rows")
    return repair(store, bad, training.umpire_training_fact(tables), UMPIRE_KINDS, **options)


def repair_batters(store: ModelStore, tables: GameTables, **options) -> int:
    """Batters with too few pitches never had a model, so there is none to repair."""
    bad = bad_batter_models(store.current()).where(F.col("status") != "too_few_rows")
    return repair(store, bad, training.batter_training_fact(tables), BATTER_KINDS, **options)
