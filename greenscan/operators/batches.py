"""Results written batch by batch, so that a run that dies loses one batch at most.

A run folder holds:

* ``plan``: one row, the number of batches and what the run is over; written first, kept by
  every later run of the same folder;
* ``input/_batch=<k>``: the rows to work on, dealt to batches by a hash of their id, written
  once (a batch then reads its own rows and not the whole table);
* ``rows/_batch=<k>``: the results of batch k, written with overwrite;
* ``done/batch=<k>``: the manifest, one row per finished batch, written after its results.

Only batches in the manifest are results. A batch that was cut off has rows without a manifest
entry: it is invisible, and the next run overwrites it. Everything is files on the shared file
system, written by Spark; batches are worked on one after another, each by a whole cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "_batch"


def _table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def batch_of(row_id, batches: int):
    """The batch of a row: its id decides, rows without one go by chance of their content."""
    return F.pmod(F.xxhash64(row_id), F.lit(batches)).cast("int")


def finished(spark: SparkSession, folder: str) -> set[int]:
    """Batches in the manifest; as many rows as batches."""
    done = _table(spark, f"{folder}/done")
    return set() if done is None else {r["batch"] for r in done.select("batch").distinct().collect()}


def run_batches(todo: DataFrame, folder: str, id_col: str, work: Callable[[DataFrame], DataFrame], batches: int = 16,
                name: str = "", after: Callable[[int], None] | None = None) -> DataFrame:
    """``work`` applied to every row of ``todo``, a batch at a time; the rows of all finished
    batches. Called again on the same folder it goes on where the last call ended, with the
    first call's input and batches; ``name`` (for example the settings) must be the same.

    ``work`` maps rows to result rows, each by itself: results must not depend on the batch a
    row is in. ``after(k)`` is called when batch k is in the manifest."""
    spark, folder = todo.sparkSession, folder.rstrip("/")
    plan = _table(spark, f"{folder}/plan")
    if plan is None:
        key = F.coalesce(F.col(id_col).cast("string"), F.to_json(F.struct(*todo.columns)))
        dealt = todo.withColumn(BATCH, batch_of(key, batches))
        # the plan is written last: an input that was cut off is dealt anew
        dealt.write.mode("overwrite").partitionBy(BATCH).parquet(f"{folder}/input")
        spark.createDataFrame([(batches, name)], "batches int, name string").coalesce(1).write.parquet(f"{folder}/plan")
    else:
        first = plan.first()
        if first["name"] != name:
            raise ValueError(f"this folder holds another run: {first['name']!r}, not {name!r}")
        batches = first["batches"]
    have = T.StructType([*todo.schema.fields, T.StructField(BATCH, T.IntegerType())])
    given = _table(spark, f"{folder}/input", have)
    done = finished(spark, folder)
    for k in sorted(set(range(batches)) - done):
        rows = todo.limit(0) if given is None else given.where(F.col(BATCH) == k).drop(BATCH)
        work(rows).write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={k}")
        spark.createDataFrame([(k,)], "batch int").coalesce(1).write.mode("append").parquet(f"{folder}/done")
        if after:
            after(k)
    return read_batches(spark, folder)


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the batches in the manifest."""
    folder = folder.rstrip("/")
    done = sorted(finished(spark, folder))
    if not done:
        raise ValueError(f"no finished batch in {folder}")
    spark.catalog.refreshByPath(f"{folder}/rows")
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/{BATCH}={k}" for k in done])
    return rows.drop(BATCH)
