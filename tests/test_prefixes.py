"""Window sums and running totals against plain loops."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from calledzone.operators.prefixes import window_sums
from calledzone.operators.running import with_running

ROWS = "game_date date, stand string, umpire long, cell int, n int, s int"
TASKS = "model_key string, season int, entity_id long, stand string, d_s date, d_e date"


def made(seed=1):
    draw = random.Random(seed)
    rows = []
    for season in (2014, 2015):
        start = date(season, 3, 20)
        for _ in range(400):
            rows.append((start + timedelta(days=draw.randrange(220)), draw.choice("RLX"), draw.randrange(3), draw.randrange(6), 1, draw.randrange(2)))
    # A third of all rows on one day, hand and cell.
    rows += [(date(2015, 6, 1), "R", 1, 2, 1, 1)] * 400
    return rows


def windows(kinds):
    found = []
    for season in (2014, 2015):
        jan = date(season, 1, 1)
        ends = [date(season, m, 30) for m in range(4, 11)]
        spans = {"ytd": [(jan, e) for e in ends], "month": [(date(season, m, 1), date(season, m, 28)) for m in range(3, 11)],
                 "season": [(jan, date(season + 1, 1, 1))], "wide": [(date(season, 4, 15), e) for e in ends[1:]],
                 "day": [(date(season, 6, d), date(season, 6, d + 1)) for d in range(1, 29)],
                 "empty": [(jan, jan), (date(season, 5, 9), date(season, 5, 2))]}
        found += [(season, *w) for kind in kinds for w in spans[kind]]
    return found


@pytest.mark.parametrize("kinds", [("ytd",), ("month",), ("day", "season"), ("wide",), ("empty",),
                                   ("ytd", "month", "season", "wide", "day", "empty")])
def test_window_sums_equal_a_loop(spark, kinds):
    rows = made()
    for on in (("stand",), ("umpire", "stand"), ()):
        tasks = [(f"{d_s}{d_e}{hand}{umpire}", season, umpire, hand, d_s, d_e)
                 for season, d_s, d_e in windows(kinds) for hand in "RL" for umpire in (range(2) if "umpire" in on else [None])]
        if not on:
            tasks = [t for t in tasks if t[3] == "R"]
        want = defaultdict(lambda: [0, 0])
        for key, season, umpire, hand, d_s, d_e in tasks:
            for day, stand, ump, cell, n, s in rows:
                if d_s <= day < d_e and ("stand" not in on or stand == hand) and ("umpire" not in on or ump == umpire):
                    want[key, cell][0] += n
                    want[key, cell][1] += s
        frame = spark.createDataFrame(tasks, TASKS).withColumn("umpire", F.col("entity_id"))
        got = window_sums(spark.createDataFrame(rows, ROWS), frame, on, ("cell",), ("n", "s"))
        found = [(r.model_key, r.cell, r.n, r.s) for r in got.collect()]
        assert sorted(found) == sorted((k, c, n, s) for (k, c), (n, s) in want.items()), (kinds, on)


def test_no_rows_and_no_tasks(spark):
    rows, tasks = spark.createDataFrame(made(), ROWS), spark.createDataFrame([], TASKS)
    assert window_sums(rows, tasks, ("stand",), ("cell",), ("n",)).count() == 0
    some = spark.createDataFrame([("a", 2015, None, "R", date(2015, 1, 1), date(2015, 5, 1))], TASKS)
    assert window_sums(rows.limit(0), some, ("stand",), ("cell",), ("n",)).count() == 0


@pytest.mark.parametrize("ranges", [None, 1, 5, 40])
def test_running_totals_over_ranges(spark, ranges):
    draw = random.Random(7)
    # Most values lie in one hair's breadth, as saturated scores do.
    rows = [(draw.choice("ab"), 1.0 - draw.random() * 1e-12 if draw.random() < 0.8 else draw.random(), i, draw.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, i int, w int")
    got = with_running(df, ["g"], [F.desc("v"), F.asc("i")], {"upto": "w"}, ranges)
    want, total = [], defaultdict(int)
    for g, v, i, w in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        total[g] += w
        want.append((g, v, i, w, total[g]))
    assert sorted(map(tuple, got.select("g", "v", "i", "w", "upto").collect())) == sorted(want)


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double, w int")
    assert with_running(df, ["g"], [F.desc("v")], {"upto": "w"}).count() == 0
    assert with_running(df, [], [F.desc("v")], {"upto": "w"}).count() == 0


def test_crowded_scores_are_spread(spark):
    """Nine tenths of the scores within 1e-9 of 1: no range holds much more than its share."""
    df = spark.range(20000).select(F.lit("m").alias("g"), (F.lit(1.0) - F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(
        F.rand(2) * 1e-9)).alias("v"), F.lit(1).alias("w"))
    placed = df.repartitionByRange(20, F.asc("g"), F.desc("v")).groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in placed.collect()) < 4000
    assert with_running(df, ["g"], [F.desc("v")], {"upto": "w"}, 20).agg(F.max("upto")).first()[0] == 20000
