"""Ids already seen by a stream, as keyed state instead of reads of the sink.

The state store remembers every id for ``bound`` after its first arrival and drops its later
copies; no micro-batch reads what earlier ones wrote, so a batch costs what it holds. With a
time column the bound is event time: rows older than the watermark are late and are left out,
as Spark defines it. Without one, arrival is the time, and no row is ever late.

Rows without an id cannot be told from each other by id: each is kept (its file and its place
there are its key, so a replayed batch gives the same keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
SEEN_KEY, SEEN_AT = "_seen_key", "_seen_at"


def use_rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks with changes in the checkpoint, not in the heap: ids kept
    are bounded by disk. A provider that the session names itself stays."""
    if spark.conf.get(PROVIDER_SETTING, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER_SETTING, ROCKSDB)


def seen_key(id_col: Column) -> Column:
    """The state's key: the id as text, or the row's own place when it has none."""
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return F.coalesce(F.concat(F.lit("id:"), id_col.cast("string")), F.concat(F.lit("row:"), place))


def skip_seen(stream: DataFrame, id_col: str, bound: str = "7 days", time_col: str | None = None) -> DataFrame:
    """The rows whose id the stream has not delivered within ``bound``; columns stay as they
    are. ``stream`` is a file stream as read (its ``_metadata`` names rows without an id)."""
    use_rocksdb(stream.sparkSession)
    columns = stream.columns
    if time_col:
        # a row without a time is as old as its arrival: it is never late
        at = F.coalesce(F.col(time_col).cast("timestamp"), F.current_timestamp())
    else:
        at = F.current_timestamp()
    keyed = stream.withColumn(SEEN_KEY, seen_key(F.col(id_col))).withColumn(SEEN_AT, at)
    return keyed.withWatermark(SEEN_AT, bound).dropDuplicatesWithinWatermark([SEEN_KEY]).select(*columns)


__all__ = ["ROCKSDB", "seen_key", "skip_seen", "use_rocksdb"]
