"""The latest N pitches of a window, against a plain ranking."""

import random
from datetime import date, timedelta

import pytest

from calledzone.operators import windows as W

SCHEMA = "pitch_id long, game_date date, stand string"


def brute(rows, tasks, limit):
    kept = set()
    for key, d_s, d_e, stand in tasks:
        inside = [r for r in rows if d_s <= r[1] < d_e and r[2] == stand]
        inside.sort(key=lambda r: (r[1], r[0]), reverse=True)
        kept |= {(key, r[0]) for r in inside[:limit]}
    return kept


@pytest.mark.parametrize("limit,slice_rows", [(3, 1000), (40, 1000), (40, 7), (500, 7), (60, 5)])
def test_latest_per_window(spark, limit, slice_rows):
    draw = random.Random(limit)
    start = date(2015, 4, 1)
    # A third of all pitches on one day and hand.
    rows = [(i * 13 + draw.randrange(13), start + timedelta(days=draw.randrange(40)), draw.choice("RL")) for i in range(400)]
    rows += [(10_000 + i, start + timedelta(days=11), "R") for i in range(200)]
    tasks = [
        (f"{days}{hand}", start, start + timedelta(days=days), hand)
        for days in (12, 20, 40) for hand in "RL"
    ]
    fact = spark.createDataFrame(rows, SCHEMA)
    windows = spark.createDataFrame(tasks, "model_key string, d_s date, d_e date, stand string")
    found = W.latest_per_window(fact, windows, ("stand",), limit, slice_rows).collect()
    assert len(found) == len({(r.model_key, r.pitch_id) for r in found})
    assert {(r.model_key, r.pitch_id) for r in found} == brute(rows, tasks, limit)


def test_two_pitches_on_the_last_day(spark):
    day = date(2015, 5, 1)
    rows = [(1, day, "R"), (2, day + timedelta(1), "R"), (3, day + timedelta(2), "R"),
            (4, day + timedelta(3), "R"), (5, day + timedelta(3), "R")]
    tasks = spark.createDataFrame(
        [("w", day, day + timedelta(9), "R")], "model_key string, d_s date, d_e date, stand string"
    )
    fact = spark.createDataFrame(rows, SCHEMA)
    found = W.latest_per_window(fact, tasks, ("stand",), 3).collect()
    assert {r.pitch_id for r in found} == {3, 4, 5}
