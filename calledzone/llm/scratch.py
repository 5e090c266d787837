"""Cut points in the shared folder, and batches of bounded size for Python tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package

# Hashes and arrays made of a slice take tens of times its bytes, in every worker of an executor.
BATCH_BYTES = 1 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_folder(spark)}/calledzone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as a table and read it back: later jobs start there, also after a lost executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by keep(), once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        root = f"{shared_folder(spark)}/calledzone-{spark.sparkContext.applicationId}/"
        jvm = spark.sparkContext._jvm
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if root.rstrip("/").rsplit("/", 1)[1] in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                conf = spark.sparkContext._jsc.hadoopConfiguration()
                path.getFileSystem(conf).delete(path, True)


def two_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that other columns cannot clash. Null text is empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for rows whose labels are never learned from."""
    name = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(name.cast("string")) % 3 == 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `max_bytes` of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package available to the Python workers, in batches that suit whole texts.

    Spark's default of 10,000 rows a batch is meant for numbers; with texts a batch takes tens of MB on both sides of
    the pipe. A session that sets the number itself keeps its own.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":
        conf.set(BATCH_ROWS, "1000")
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        # The worker is used again by other stages: what this one took goes back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
