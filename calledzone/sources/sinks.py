"""Stored results: published tables of scores and zones, the model store, and dated reports."""

import time
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from calledzone import schema as S
from calledzone.session import materialise
from calledzone.sources.published import PublishedTable, Versions

REMOVED = "removed"
REPORT_FILE_ROWS = 1_000_000


def scores_table(spark: SparkSession, root: str, schema: StructType = S.UMPIRE_UCS) -> PublishedTable:
    """Umpire scores, or with S.UMPIRE_ROC the comparison table, in versions; a part a season."""
    return PublishedTable(spark, root, StructType([*schema, StructField("season", IntegerType())]))


def zones_table(spark: SparkSession, root: str) -> PublishedTable:
    return PublishedTable(spark, root, S.BATTER_ZONES, ("year",))


def _with_season(df: DataFrame) -> DataFrame:
    return df if "season" in df.columns else df.withColumn("season", F.year("date"))


def overwrite_seasons(df: DataFrame, to: str | PublishedTable, notes=None) -> None:
    """Replace just the seasons `df` holds; writing the same rows twice changes nothing.

    A published table switches to the new rows at once; a plain path is for results nobody reads meanwhile.
    """
    rows = _with_season(df)
    if isinstance(to, PublishedTable):
        to.replace_parts(rows, notes)
        return
    (
        # Even files: small seasons are merged, a large one is split.
        rows.hint("rebalance", "season")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("season")
        .parquet(to)
    )


def write_umpire_ucs(scores: DataFrame, to: str | PublishedTable, notes=None) -> None:
    overwrite_seasons(scores.select(*S.UMPIRE_UCS.fieldNames()), to, notes)


def append_umpire_roc(scores: DataFrame, to: str | PublishedTable) -> None:
    """Add rows to the comparison table, for runs that score it in parts."""
    rows = _with_season(scores.select(*S.UMPIRE_ROC.fieldNames()))
    if isinstance(to, PublishedTable):
        to.append(rows)
    else:
        rows.write.mode("append").partitionBy("season").parquet(to)


def replace_umpire_roc(scores: DataFrame, to: str | PublishedTable) -> None:
    """Empty the comparison table and write this run's rows; readers of a published one never see it empty."""
    rows = _with_season(scores.select(*S.UMPIRE_ROC.fieldNames()))
    if isinstance(to, PublishedTable):
        to.replace(rows)
    else:
        rows.write.mode("overwrite").partitionBy("season").parquet(to)


def write_batter_zones(zones: DataFrame, to: str | PublishedTable, notes=None) -> None:
    """Replace the zones of the seasons given; those of other seasons stay."""
    rows = zones.select(*S.BATTER_ZONES.fieldNames())
    if isinstance(to, PublishedTable):
        to.replace_parts(rows, notes)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(to)


def _report_root(folder: str, name: str, day: date) -> str:
    return f"{folder}/{name}/run_date={day.isoformat()}"


def write_report(report: DataFrame, folder: str, name: str, day: date) -> str:
    """Space-separated text with a header, in a folder of this writing; `report_path` names it once it is whole."""
    spark, root = report.sparkSession, _report_root(folder, name, day)
    report = materialise(report)
    files = max(1, -(-report.count() // REPORT_FILE_ROWS))
    write = f"v={uuid.uuid4().hex}"
    report.repartition(files).write.csv(f"{root}/{write}", sep=" ", header=True, quote="", emptyValue="", nullValue="NA")
    Versions(spark, root).publish(lambda old: {"": [write]})
    return f"{root}/{write}"


def report_path(spark: SparkSession, folder: str, name: str, day: date) -> str | None:
    """Where the newest whole report of that name and day lies."""
    root = _report_root(folder, name, day)
    held = Versions(spark, root).parts().get("")
    return f"{root}/{held[0]}" if held else None


class ModelStore:
    """Nets in one append-only table of versions; the newest row of a key counts.

    A removal is a row too. `compact` folds rows and removals into a new base, so that a reader meets the
    base and the appends since. A version of the table is a number that a job can note and read again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root}/models"
        self.bucket_path = f"{root}/bucket_models"
        self.backup_path = f"{root}/models_backup"
        self.models = PublishedTable(
            spark, self.path, StructType([*S.MODELS, StructField("version", LongType())]), ("kind", "season"))
        self.bucket_models = PublishedTable(spark, self.bucket_path, S.BUCKET_MODELS)

    def _append(self, models: DataFrame) -> None:
        self.models.append(models.select(*S.MODELS.fieldNames()).withColumn("version", F.lit(time.time_ns())))

    def save(self, models: DataFrame) -> None:
        self._append(models)

    def remove(self, models: DataFrame) -> None:
        self._append(models.withColumn("status", F.lit(REMOVED)))

    def remove_season(self, season: int, kinds: tuple[str, ...]) -> None:
        self.remove(self.current().where((F.col("season") == season) & F.col("kind").isin(*kinds)))

    def version(self) -> int | None:
        return self.models.version()

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        """Newest row of each key, with its version; removed keys are gone."""
        newest = rows.groupBy("kind", "season", "model_key").agg(
            F.max_by(F.struct(*S.MODELS.fieldNames()), "version").alias("m"), F.max("version").alias("version"))
        return newest.select("m.*", "version").where(F.col("status") != REMOVED)

    def current(self, version: int | None = None) -> DataFrame:
        """Every stored model in its newest version, failed fits included; or as of a version of the table."""
        return self._newest(self.models.read(version)).select(*S.MODELS.fieldNames())

    def compact(self) -> int:
        """Fold all rows into a new base: `current` then reads it and what is appended later."""
        return self.models.compact(self._newest)

    def backup(self, season: int, kinds: tuple[str, ...], at: datetime) -> str:
        """Copy a season's models aside before they are refitted."""
        path = f"{self.backup_path}/snapshot_ts={at:%Y%m%d.%H%M%S}"
        rows = self.current().where((F.col("season") == season) & F.col("kind").isin(*kinds))
        rows.write.mode("overwrite").partitionBy("kind").parquet(path)
        return path

    def save_buckets(self, buckets: DataFrame) -> None:
        """Replace the bucket models of the seasons given."""
        overwrite_seasons(buckets.select(*S.BUCKET_MODELS.fieldNames()), self.bucket_models)

    def buckets(self, version: int | None = None) -> DataFrame:
        return self.bucket_models.read(version)
