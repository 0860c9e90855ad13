"""Session helpers: a local session for tests and tools, and the checkpoint folder.

Jobs read ``spark.checkpoint.dir`` from the session (a shared folder on a cluster);
only when it is unset - local runs and tests - do we set one of our own.
"""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import SparkSession


_OWN: list[str] = []


def get_spark(cores: int | str = 8, app: str = "greenscan") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; set only when unset and
    the master is local (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if not _OWN:  # the setting is fixed once a session runs, so our own folder is kept here
        _OWN.append(tempfile.mkdtemp(prefix="greenscan-ckpt-"))
    return _OWN[0]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    d = checkpoint_root(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for written intermediate tables."""
    import uuid
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/greenscan/{name}-{uuid.uuid4().hex[:12]}"


def kept(df, name: str):
    """The rows written as a Parquet table under the checkpoint folder and read again: computed
    once, whatever reads them, and read column by column. Shuffle files of work that is over
    stay on disk until the driver collects its garbage, so it is told to, twice: at first the
    listeners may not have heard of the end of the writing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for wait in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
    return spark.read.schema(df.schema).parquet(path)


__all__ = ["get_spark", "checkpoint_root", "ensure_checkpoint_dir", "kept", "scratch_path"]
