"""Date windows models are fitted on, and the fit tasks made from them.

A window is half open, [d_s, d_e). Its end is the last day of the period, which
therefore stays out unless `include_last_day` is set.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S

DAY, MONTH, YEAR_TO_DATE, SEASON = "day", "month", "ytd", "season"


def _end(day: Column, include_last_day: bool) -> Column:
    return F.date_add(day, 1) if include_last_day else day


def month_windows(seasons: DataFrame, include_last_day: bool = False) -> DataFrame:
    """One window per calendar month from opening day to closing day."""
    month = F.col("first_day")
    starts = F.sequence(
        F.trunc("min_date", "MM").cast("date"), F.col("max_date"), F.expr("interval 1 month")
    )
    return seasons.select("season", "min_date", "max_date", F.explode(starts).alias("first_day")).select(
        "season",
        F.month(month).alias("month"),
        F.greatest("min_date", "first_day").alias("d_s"),
        _end(F.least(F.col("max_date"), F.last_day(month)), include_last_day).alias("d_e"),
        F.lit(MONTH).alias("span"),
    )


def day_windows(seasons: DataFrame) -> DataFrame:
    """One window per day from opening day to closing day, closing day included."""
    days = F.sequence("min_date", "max_date", F.expr("interval 1 day"))
    return seasons.select("season", F.explode(days).alias("d_s")).select(
        "season", F.month("d_s").alias("month"), "d_s", F.date_add("d_s", 1).alias("d_e"),
        F.lit(DAY).alias("span"),
    )


def year_windows(seasons: DataFrame, include_last_day: bool = False) -> DataFrame:
    last = F.make_date("season", F.lit(12), F.lit(31))
    return seasons.select(
        "season",
        F.lit(None).cast("int").alias("month"),
        F.make_date("season", F.lit(1), F.lit(1)).alias("d_s"),
        _end(last, include_last_day).alias("d_e"),
        F.lit(SEASON).alias("span"),
    )


def year_to_date(months: DataFrame) -> DataFrame:
    """Add the window from January 1st to day 30 of each row's (season, month).

    February ends on its own last day.
    """
    first = F.make_date("season", "month", F.lit(1))
    return (
        months.withColumn("d_s", F.make_date("season", F.lit(1), F.lit(1)))
        .withColumn("d_e", F.least(F.date_add(first, 29), F.last_day(first)))
        .withColumn("span", F.lit(YEAR_TO_DATE))
    )


def last_day_of_month(day: Column) -> Column:
    return F.day(F.last_day(day))


def previous_month(day: Column) -> Column:
    """First day of the month before: scores must not see the models of their own month."""
    return F.add_months(F.trunc(day, "MM"), -1).cast("date")


def model_month(d_e: Column) -> Column:
    """Month a monthly or year-to-date model stands for."""
    return F.trunc(d_e, "MM").cast("date")


def per_hand(windows: DataFrame, hands: Iterable[str] = S.HANDS) -> DataFrame:
    """Every window once per hand."""
    return windows.withColumn("stand", F.explode(F.array(*[F.lit(h) for h in hands])))


def model_key(kind: Column) -> Column:
    return F.concat_ws(
        ".",
        kind,
        F.coalesce(F.col("entity_id").cast("string"), F.lit("generic")),
        F.col("span"), F.col("d_s"), F.col("d_e"),
        F.coalesce(F.col("stand"), F.lit("B")),
    )


def as_tasks(windows: DataFrame, kind: str) -> DataFrame:
    """Rows of the model table before fitting; pooled windows carry no entity id."""
    if "entity_id" not in windows.columns:
        windows = windows.withColumn("entity_id", F.lit(None).cast("long"))
    if "stand" not in windows.columns:
        windows = windows.withColumn("stand", F.lit(None).cast("string"))
    tasks = windows.withColumn("kind", F.lit(kind)).withColumn("model_key", model_key(F.lit(kind)))
    return tasks.select(*[f.name for f in S.TASK.fields])
