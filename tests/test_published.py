"""Versioned tables: readers see whole versions, whatever happens to writers."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from calledzone.sources.published import PublishedTable

SCHEMA = StructType([
    StructField("id", LongType()), StructField("season", IntegerType()), StructField("name", StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return PublishedTable(spark, str(tmp_path / "table"), SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


FIRST = [(1, 1998, "a"), (2, 1999, "b"), (3, None, None)]


def test_empty_until_published(spark, table):
    assert table.version() is None and table.read().count() == 0
    assert table.read().schema == SCHEMA
    assert table.replace(frame(spark, *FIRST)) == 1
    assert rows_of(table.read()) == sorted(FIRST, key=str)
    assert table.read().schema.fieldNames() == SCHEMA.fieldNames()
    assert table.replace(frame(spark)) == 2 and table.read().count() == 0
    assert rows_of(table.read(1)) == sorted(FIRST, key=str)


def test_parts_not_touched_are_shared(spark, table):
    table.replace(frame(spark, *FIRST))
    table.replace_parts(frame(spark, (9, 1999, "c")))
    assert rows_of(table.read()) == sorted([FIRST[0], FIRST[2], (9, 1999, "c")], key=str)
    assert table.versions.parts(1)["season=1998"] == table.versions.parts(2)["season=1998"]
    table.append(frame(spark, (10, 1999, "d"), (11, 2000, "e")))
    assert rows_of(table.read()) == sorted([FIRST[0], FIRST[2], (9, 1999, "c"), (10, 1999, "d"), (11, 2000, "e")], key=str)


def test_writing_twice_changes_nothing(spark, table):
    for _ in range(2):
        table.replace_parts(frame(spark, *FIRST))
    assert rows_of(table.read()) == sorted(FIRST, key=str)


def test_a_failed_write_leaves_the_old_rows(spark, table):
    """Tasks of the first season are done when one of the second fails; nothing of it is seen."""
    table.replace(frame(spark, *FIRST))
    before = table.read()
    broken = spark.range(0, 200, 1, 4).select(
        "id", (F.lit(1998) + (F.col("id") > 100).cast("int")).alias("season"),
        F.when(F.col("id") < 199, "x").otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("name"))
    for write in (table.replace, table.replace_parts, table.append):
        with pytest.raises(Exception, match="lost"):
            write(broken)
        assert table.version() == 1
        assert rows_of(table.read()) == rows_of(before) == sorted(FIRST, key=str)


def test_an_open_reader_keeps_its_rows(spark, table):
    table.replace(frame(spark, *FIRST))
    opened = table.read()
    table.replace(frame(spark, (5, 1998, "new")))
    assert rows_of(opened) == sorted(FIRST, key=str) and rows_of(table.read()) == [(5, 1998, "new")]


def test_a_table_can_be_written_from_its_own_rows(spark, table):
    table.replace(frame(spark, *FIRST))
    table.replace(table.read().where("id > 1").withColumn("name", F.lit("z")))
    assert rows_of(table.read()) == sorted([(2, 1999, "z"), (3, None, "z")], key=str)


def test_two_writers_do_not_lose_parts(spark, table):
    """Both write at once, many times; a part of each is there in the end."""
    errors = []

    def write(season):
        try:
            for turn in range(4):
                PublishedTable(spark, table.root, SCHEMA).replace_parts(frame(spark, (turn, season, "x")))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    writers = [threading.Thread(target=write, args=(season,)) for season in (1, 2)]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    assert not errors
    assert rows_of(table.read()) == [(3, 1, "x"), (3, 2, "x")] and table.versions.all() == list(range(1, 9))


def test_a_taken_number_is_not_written_over(table):
    assert table.files.create(table.versions.path(1), "one") and not table.files.create(table.versions.path(1), "two")
    assert table.files.read(table.versions.path(1)) == "one"
    assert [n for n in table.files.names(f"{table.root}/_versions") if not n.endswith(".crc")] == ["000000000001.json"]


def test_old_versions_can_be_removed(spark, table):
    for n in range(4):
        table.replace_parts(frame(spark, (n, 1998, "a"), (n, 2000 + n, "b")), {"turn": n})
    want = rows_of(table.read())
    assert table.versions.notes(2) == {"turn": 1}
    stray = table.stage(frame(spark, (7, 1998, "unpublished")))
    assert table.vacuum(keep=1) == 3
    assert table.versions.all() == [4] and rows_of(table.read()) == want
    assert table.vacuum(keep=1, now_ms=1 << 60) == 1
    assert "unpublished" not in {r.name for r in spark.read.parquet(table.root).collect()} and stray
    assert rows_of(table.read()) == want
    with pytest.raises(ValueError):
        table.vacuum(keep=0)


def test_compaction_keeps_what_was_appended_meanwhile(spark, table):
    for n in range(3):
        table.append(frame(spark, (n, 1998, "a"), (n, 1999 + n, "b")))

    def fold(rows):
        table.append(frame(spark, (50, 1998, "late"), (51, 2020, "late")))
        return rows.where("id > 0")

    before = rows_of(table.read())
    table.compact(fold)
    late = [(50, 1998, "late"), (51, 2020, "late")]
    assert rows_of(table.read()) == sorted([r for r in before if r[0] > 0] + late, key=str)
    assert len(table.versions.parts()["season=1998"]) == 2 and len(table.versions.parts()["season=2001"]) == 1


def test_restore(spark, table):
    table.replace(frame(spark, *FIRST))
    table.replace(frame(spark, (5, 1998, "new")))
    assert table.versions.restore(1) == 3 and rows_of(table.read()) == sorted(FIRST, key=str)


def test_a_season_filter_skips_folders(spark, table):
    table.replace(frame(spark, *FIRST))
    plan = table.read().where("season = 1998")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
