"""Bucketed storage: the same pitches, and none of them exchanged."""

import pytest
from pyspark.sql import functions as F

from calledzone.operators.pitches import called_pitches, judged_pitches
from calledzone.sources.bucketed import bucket_tables, open_bucketed


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def root(tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bucketed") / "tables")
    bucket_tables(tables, folder, "test_pitching", 8)
    return folder


def test_bucketed_tables_give_the_same_pitches(spark, tables, root):
    stored = open_bucketed(spark, root, "test_pitching", 8, tables.zones)
    assert rows_of(called_pitches(stored)) == rows_of(called_pitches(tables))
    one = open_bucketed(spark, root, "test_pitching", 8, tables.zones, seasons=[1998])
    assert rows_of(called_pitches(one)) == rows_of(called_pitches(tables).where("season = 1998"))


def test_another_session_declares_them_again(spark, tables, root):
    """Dropped from the catalog only: the files stay, and the layout is named anew."""
    want = rows_of(open_bucketed(spark, root, "test_pitching", 8).pitches)
    for table in ("atbats", "pitches"):
        spark.sql(f"DROP TABLE test_pitching_{table}")
    stored = open_bucketed(spark, root, "test_pitching", 8, tables.zones)
    assert rows_of(stored.pitches) == want != []
    assert "Bucketed: true" in explained(spark, called_pitches(stored))


def explained(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fact", [called_pitches, judged_pitches])
def test_pitches_are_not_exchanged(spark, tables, root, fact):
    """With every join shuffled, as with large tables: at-bats move to the pitches' buckets, pitches stay."""
    before = {key: spark.conf.get(key) for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = explained(spark, fact(open_bucketed(spark, root, "test_pitching", 8, tables.zones)))
        loose = explained(spark, fact(tables))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # Every exchange below which pitches are read; the plan prints children under their parents, deeper.
    assert exchanges_above_pitches(plan) == 0 and exchanges_above_pitches(loose) > 0


def exchanges_above_pitches(plan):
    found, above = 0, []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        above = [(d, text) for d, text in above if d < depth] + [(depth, line)]
        if "FileScan" in line and ("gamedayPitchID" in line or "l_linenumber" in line):
            found += sum("Exchange" in text for _, text in above)
    return found
