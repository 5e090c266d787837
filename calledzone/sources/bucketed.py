"""Game tables in buckets, so that at-bats and pitches meet without moving the pitches.

Pitches and at-bats are stored in the same number of buckets by (game, at-bat), sorted in them, a folder a season. A
join on these keys reads bucket by bucket; only the at-bats, several times fewer, are ever exchanged.

    bucket_tables(lake.tables(), "s3a://lake/bucketed", "pitching", buckets=512)
    tables = open_bucketed(spark, "s3a://lake/bucketed", "pitching", buckets=512, seasons=[2018])

The number of buckets and the name belong to the layout: a session that did not write it declares it again with the same ones.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from calledzone import schema as S
from calledzone.sources.tables import GameTables, with_calendar

KEYS = {"atbats": ("gameName", "num"), "pitches": ("gameName", "gameAtBatID")}
PLAIN = {"games": S.GAMES, "umpires": S.UMPIRES}
CALENDAR = (StructField("game_date", DateType()), StructField("month", IntegerType()), StructField("season", IntegerType()))


def bucket_tables(tables: GameTables, root: str, name: str, buckets: int) -> None:
    """Store the tables under `root`; the two large ones as catalog tables `name`_atbats and `name`_pitches in buckets.

    A folder that holds tables already is an error: write a new layout beside the old one and switch to it.
    """
    for table in PLAIN:
        with_calendar(getattr(tables, table)).write.partitionBy("season").parquet(f"{root}/{table}")
    for table, keys in KEYS.items():
        # Dealt as the buckets are, so that a bucket of a season is one file.
        rows = with_calendar(getattr(tables, table)).repartition(buckets, *keys)
        (
            rows.write.partitionBy("season").bucketBy(buckets, *keys).sortBy(*keys)
            .option("path", f"{root}/{table}").saveAsTable(f"{name}_{table}")
        )


def _declare(spark: SparkSession, root: str, name: str, buckets: int) -> None:
    """Name the stored tables in this session's catalog, if they are not named yet."""
    for table, schema in (("atbats", S.ATBATS), ("pitches", S.PITCHES)):
        if spark.catalog.tableExists(f"{name}_{table}"):
            continue
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType([*schema, *CALENDAR]))
        keys = ", ".join(KEYS[table])
        spark.sql(
            f"CREATE TABLE {name}_{table} ({columns}) USING parquet PARTITIONED BY (season) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(buckets)} BUCKETS LOCATION '{root}/{table}'")
        spark.catalog.recoverPartitions(f"{name}_{table}")


def open_bucketed(
    spark: SparkSession, root: str, name: str, buckets: int, zones: DataFrame | None = None,
    seasons: Iterable[int] | None = None,
) -> GameTables:
    """The stored tables, of some seasons only if they are given: folders of other seasons are skipped.

    Pitches come without a season column, as a join on more than the bucketed keys would move them.
    """
    _declare(spark, root, name, buckets)
    wanted = None if seasons is None else tuple(seasons)

    def of_seasons(df: DataFrame) -> DataFrame:
        return df if wanted is None else df.where(F.col("season").isin(*wanted))

    def plain(table):
        schema = StructType([*PLAIN[table], *CALENDAR])
        return of_seasons(spark.read.schema(schema).parquet(f"{root}/{table}"))

    return GameTables(
        games=plain("games"), umpires=plain("umpires"), atbats=of_seasons(spark.table(f"{name}_atbats")),
        pitches=of_seasons(spark.table(f"{name}_pitches")).drop("season", "game_date", "month"), zones=zones,
    )
