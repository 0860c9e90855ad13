"""Small helpers of the subpackage: tables, written intermediates, files that tasks write."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from greenscan.session import scratch_path


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
BYTES_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table. Python workers started from here on look for the package where we found it,
    and get Arrow batches of at most ``BATCH_ROWS`` rows and (beyond the first row)
    ``BATCH_BYTES`` bytes: a task holds a batch several times (JVM, Arrow, Python objects), and
    documents may be long. Both settings stay for the session."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if spark.conf.get(BYTES_SETTING) in ("67108864b", "67108864"):  # as delivered
        spark.conf.set(BYTES_SETTING, f"{BATCH_BYTES}b")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read again: cuts the
    lineage, survives lost executors, and is read column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared file system for files that tasks write themselves."""
    return scratch_path(spark, name)


def open_fs(uri: str):
    """(file system, path) of a URI or a local path, on a driver or an executor."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(kind: str, part: int) -> str:
    """A file name of its own for every task attempt. A task tells the names of its files in
    its output rows, so files of lost or repeated attempts are never read."""
    return f"{kind}-{part:05d}-{uuid.uuid4().hex[:12]}"


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares without case)."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted
