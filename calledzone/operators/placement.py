"""Costly rows dealt to tasks by what they cost."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone.operators.running import with_running
from calledzone.session import materialise

# Cost of a task where there is more work than cores; in points times weights of a net.
TASK_COST = 20_000_000
TASKS_PER_CORE = 3


def slots_for(total: int, cores: int, task_cost: int = TASK_COST) -> int:
    """Number of tasks: a few a core, so that unequal ones even out, and no task far above `task_cost`."""
    return max(TASKS_PER_CORE * cores, -(-total // task_cost))


def dealt_by_cost(costs: DataFrame, task_cost: int = TASK_COST) -> tuple[DataFrame, int]:
    """(model_key, slot) from (model_key, cost), and how many slots there are.

    Rows are laid end to end, each as long as its cost, and the line is cut into slots of one length: a slot differs from
    the mean by its last row at most. The line is a running total over ranges, so no task holds all rows.
    """
    costs = materialise(costs.select("model_key", F.greatest("cost", F.lit(1)).cast("long").alias("cost")))
    total = costs.agg(F.sum("cost")).first()[0] or 1
    slots = slots_for(total, costs.sparkSession.sparkContext.defaultParallelism, task_cost)
    line = with_running(costs, [], [F.asc("model_key")], {"upto": "cost"})
    middle = F.col("upto") - F.col("cost") / 2
    return line.select("model_key", F.least(F.floor(middle * slots / total), F.lit(slots - 1)).cast("int").alias("slot")), slots
