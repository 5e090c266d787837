"""Session settings, and the two ways a job may shorten or shrink its own plan."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lookup tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def build_session(name: str = "calledzone", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Larger methods are never compiled by the JVM; split expressions are.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for cut points; a scratch folder only in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="calledzone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder nobody has written to yet, with all others of this run in the shared folder."""
    return f"{shared_folder(spark)}/calledzone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder, for results that several branches read.

    Unlike a plain checkpoint the table is columnar, so each reader takes just its
    columns, and the planner knows its size. All tables of a run lie in one folder,
    which may be deleted once the run is over.
    """
    spark = df.sparkSession
    path = run_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of `df` only after counting it; give it cheap or written tables.

    Past the bound the join is left to the planner: a shuffled join whose hot keys AQE splits.
    """
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for functions that run in their Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="calledzone-code-")) / package.name
        sc.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place few but costly rows on all cores.

    AQE merges partitions by their bytes; a fixed count keeps it from running many
    fits or grids in one task.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * slots, *keys)
