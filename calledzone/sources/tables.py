"""Game tables from files or a database, model lists, and named report queries."""

from dataclasses import dataclass, replace
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import pitch as P


@dataclass(frozen=True)
class GameTables:
    games: DataFrame
    umpires: DataFrame
    atbats: DataFrame
    pitches: DataFrame
    zones: DataFrame | None = None

    def with_zones(self, zones: DataFrame) -> "GameTables":
        return replace(self, zones=zones)


def with_calendar(df: DataFrame) -> DataFrame:
    """Parse the game name once into game_date, season and month; drop rows without a date."""
    if "game_date" in df.columns:
        return df
    day = F.col("game_date")
    return (
        df.withColumn("game_date", P.game_date(F.col("gameName")))
        .where(day.isNotNull())
        .withColumn("season", F.year(day))
        .withColumn("month", F.month(day))
    )


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> GameTables:
    """Tables stored under `root`, one folder each; batter zones may be missing at first."""

    def load(name, schema):
        return spark.read.format(fmt).schema(schema).load(f"{root}/{name}")

    return GameTables(
        games=load("games", S.GAMES),
        umpires=load("umpires", S.UMPIRES),
        atbats=load("atbats", S.ATBATS),
        pitches=load("pitches", S.PITCHES),
    )


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    pitch_ids: tuple[int, int],
    atbat_nums: tuple[int, int],
    partitions: int,
    **options: str,
) -> GameTables:
    """The same tables from the original database, the two large ones read in ranges."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)

    def whole(name):
        return reader.option("dbtable", name).load()

    def ranged(name, column, bounds):
        return (
            spark.read.format("jdbc").option("url", url).options(**options)
            .option("dbtable", name)
            .option("partitionColumn", column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
            .load()
        )

    return GameTables(
        games=whole("games"),
        umpires=whole("umpires"),
        atbats=ranged("atbats", "num", atbat_nums),
        pitches=ranged("pitches", "gamedayPitchID", pitch_ids),
    )


def ingest(tables: GameTables, root: str) -> GameTables:
    """Store the tables with parsed dates, split by season so date filters skip folders."""
    spark = tables.pitches.sparkSession
    stored = {}
    for name in ("games", "umpires", "atbats", "pitches"):
        path = f"{root}/{name}"
        dated = with_calendar(getattr(tables, name)).hint("rebalance", "season")
        dated.write.mode("overwrite").partitionBy("season").parquet(path)
        stored[name] = spark.read.parquet(path)
    return GameTables(**stored, zones=tables.zones)


def read_model_list(spark: SparkSession, path: str) -> DataFrame:
    """Plain list of models to draw: id start end stand, no header; repeats are dropped."""
    return (
        spark.read.schema(S.MODEL_LIST)
        .csv(path, sep=" ", header=False, dateFormat="yyyy-MM-dd")
        .dropDuplicates()
    )


def run_named(spark: SparkSession, name: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run a stored query text by name, with named parameters and DataFrames as its tables."""
    text = resources.files("calledzone.sql").joinpath(f"{name}.sql").read_text()
    return spark.sql(text, args=args or {}, **frames)
