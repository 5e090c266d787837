"""Stand-in nets for the sample tables, computed from their pitches without fitting.

Each net is a box around the average called strike of its own pitches, so its
weights follow the data and can be checked by plain SQL. Some are left out or
spoiled on purpose, to exercise fallbacks and health checks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.operators import calendars as C
from calledzone.operators.prefixes import window_sums
from calledzone.operators.windows import assign_windows
from calledzone.plans import training
from calledzone.session import materialise
from calledzone.sources.tables import GameTables

STEEPNESS = 6.0
HALF_WIDTH = 0.85
HALF_HEIGHT = {"pz_ratio": 1.0, "pz": 0.88}
OUT_BIAS, BAD_UMPIRE_BIAS, BAD_BATTER_BIAS = -21.0, -30.0, -10.0
MIN_BATTER_ROWS = 10


def _counted(rows: DataFrame, height: str, *keys: str) -> DataFrame:
    """`keys` of each pitch with what is added up for a centre; places in whole thousandths, so that sums have no rounding order."""
    return rows.selectExpr(
        *keys, "1L AS n_train", "c AS s",
        "CASE WHEN c = 1 THEN floor(px * 1000D) END AS x", f"CASE WHEN c = 1 THEN floor({height} * 1000D) END AS z")


SUMS = ("n_train", "s", "x", "z")


def _centres(sums: DataFrame) -> DataFrame:
    """Average strike per model."""

    def mean(column):
        return f"try_divide(CAST({column} AS DOUBLE), CAST(s AS DOUBLE)) / 1000D"

    return sums.selectExpr("model_key", "n_train", "s", f"{mean('x')} AS mx", f"{mean('z')} AS mz")


def _box(height: str, extra: tuple[float, ...]) -> str:
    sides = (
        (HALF_WIDTH, "- mx", (1, 0)), (HALF_WIDTH, "+ mx", (-1, 0)),
        (HALF_HEIGHT[height], "- mz", (0, 1)), (HALF_HEIGHT[height], "+ mz", (0, -1)),
    )
    units = []
    for half, mean, facing in sides:
        slopes = [f"{STEEPNESS * sign}D" for sign in facing] + [f"{w}D" for w in extra]
        units.append(f"array({STEEPNESS}D * ({half}D {mean}), {', '.join(slopes)})")
    return f"array({', '.join(units)})"


def _models(
    tasks: DataFrame, rows: DataFrame, features: tuple[str, ...], bias: str = f"{OUT_BIAS}D"
) -> DataFrame:
    counted = _counted(rows, features[1], "model_key")
    sums = counted.groupBy("model_key").agg(*[F.sum(name).alias(name) for name in SUMS])
    return _models_of(tasks, sums, features, bias)


def _models_of(tasks: DataFrame, sums: DataFrame, features: tuple[str, ...], bias: str) -> DataFrame:
    height, extra = features[1], (0.05, -0.05)[: len(features) - 2]
    sound = "s > 0 AND n_train % 13 <> 0"
    names = ", ".join(f"'{name}'" for name in features)
    models = tasks.join(_centres(sums), "model_key").selectExpr(
        *S.TASK.fieldNames(),
        f"array({names}) AS features",
        "4 AS hidden",
        f"CASE WHEN {sound} THEN {_box(height, extra)} END AS w_hidden",
        f"CASE WHEN {sound} THEN array({bias}, 6D, 6D, 6D, 6D) END AS w_out",
        "n_train",
        "CAST(s AS DOUBLE) * (n_train - s) / n_train / 2D AS sse",
        "CAST(n_train % 1000 AS INT) AS steps",
        f"CASE WHEN {sound} THEN 'ok' ELSE 'not_converged' END AS status",
    )
    return materialise(models)


def _pooled_kind(movement: bool) -> tuple[str, tuple[str, ...]]:
    return (S.UMPIRE_MOVEMENT, S.MOVEMENT_FEATURES) if movement else (S.UMPIRE_GENERIC, S.ZONE_FEATURES)


def season_nets(tables: GameTables, fact: DataFrame, movement: bool = False) -> DataFrame:
    """Pooled season nets, or movement nets; none is spoiled by bias, some by a missed convergence."""
    kind, features = _pooled_kind(movement)
    tasks = training.yearly_tasks(tables.games, kind)
    rows = assign_windows(fact, tasks, ("stand",))
    return _models(tasks, rows, features)


def month_nets(tables: GameTables, fact: DataFrame, movement: bool = False) -> DataFrame:
    """Pooled month nets, or movement nets."""
    kind, features = _pooled_kind(movement)
    tasks = training.monthly_tasks(tables.games, kind)
    rows = assign_windows(fact, tasks, ("stand",))
    return _models(tasks, rows, features)


def individual_nets(tables: GameTables, fact: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Year-to-date nets; every tenth umpire's is bad."""
    tasks = training.individual_tasks(tables, last_season=9999, judged=judged)
    tasks = materialise(tasks)
    # Windows of a season overlap month by month: running totals add each pitch up once, not once a window.
    on = ("umpire", "stand")
    sums = window_sums(_counted(fact, S.ZONE_FEATURES[1], *on, "game_date"), tasks.withColumn("umpire", F.col("entity_id")), on, (), SUMS)
    bias = f"CASE WHEN entity_id % 10 = 6 THEN {BAD_UMPIRE_BIAS}D ELSE {OUT_BIAS}D END"
    return _models_of(tasks, sums, S.ZONE_FEATURES, bias)


def batter_nets(tables: GameTables, fact: DataFrame) -> DataFrame:
    """Own nets of batters with enough pitches, every tenth of them bad, and pooled nets."""
    bias = f"CASE WHEN entity_id % 10 = 4 THEN {BAD_BATTER_BIAS}D ELSE {OUT_BIAS}D END"
    tasks = materialise(training.batter_tasks(tables.atbats, after_season=0))
    own = _models(tasks, training.training_rows(fact, tasks, training.BATTERS), S.BATTER_FEATURES, bias)
    own = own.where(F.col("n_train") >= MIN_BATTER_ROWS)
    tasks = training.batter_pooled_tasks(tables.atbats, after_season=0)
    pooled = _models(tasks, assign_windows(fact, tasks, ("stand",)), S.BATTER_FEATURES)
    return own.unionByName(pooled)
