"""Global dense numbering of a sorted table without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task. Here the
table is range-sorted, materialised (so partition contents are fixed even if a
stage is recomputed), numbered inside each partition, and shifted by per-partition
offsets from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenscan.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order_cols: list, out_col: str = "rn",
                      start: int = 0) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order_cols).checkpoint(eager=True)
    tagged = ordered.select("*", F.spark_partition_id().alias("_pid"),
                            F.monotonically_increasing_id().alias("_mid"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a single-task window here is bounded by the partition count
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n"))
                            .alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid") \
        .withColumn(out_col, (F.col("_off") + local + F.lit(start)).cast("bigint"))
    return out.drop("_pid", "_mid", "_off")
