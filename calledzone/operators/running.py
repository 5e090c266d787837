"""Running totals over any number of rows, none of them ordered in one task.

Rows are dealt to tasks by sampled ranges of their order, and written with the number of their range. Totals of the ranges are
few; what lies before a range is added to the running total inside it. A hundred million equal keys do not change
that: ranges are cut by the whole order, not by one column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calledzone.session import materialise

RANGE = "range_number"


def with_running(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, str], ranges: int | None = None,
) -> DataFrame:
    """`df` with running totals (`sums`: new column to summed one) in `order` within each group of `by`.

    `order` should tell all rows of a group apart; rows it does not tell apart have their totals in any order.
    """
    spread = [*[F.col(name).asc() for name in by], *order]
    ranged = df.repartitionByRange(*([ranges] if ranges else []), *spread)
    placed = materialise(ranged.withColumn(RANGE, F.spark_partition_id()))
    totals = placed.groupBy(RANGE, *by).agg(*[F.sum(old).alias(new) for new, old in sums.items()])
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        RANGE, *by, *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"{new}_before") for new in sums])
    inside = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumns({new: F.sum(old).over(inside) for new, old in sums.items()})
    joined = running.join(offsets, [RANGE, *by])
    return joined.withColumns({new: F.col(new) + F.col(f"{new}_before") for new in sums}).drop(
        RANGE, *[f"{new}_before" for new in sums])
