"""Score a stream of documents (X1), skip ids already scored (X2), append results
idempotently (X3).

Detection is row-local (no aggregation), so it runs in append mode with any trigger. Ids that
the stream delivers again are known from keyed state (:mod:`greenscan.streaming.state`); ids
scored before the stream began are a static table in a stream-static anti join. No
micro-batch reads the sink. ``foreachBatch`` writes each micro-batch into its own
``_run=<name>/_epoch=<id>`` folder with overwrite, so a batch replayed after a failure
replaces its earlier attempt; the run is named by the id that the checkpoint keeps, so a
restarted process goes on in the same folders, and a stream whose checkpoint was lost cannot
overwrite what the first one stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenscan.config import WatermarkConfig
from greenscan.operators.detect import detect_text
from greenscan.sources.tables import SCHEMAS
from greenscan.streaming.state import skip_seen


def read_stream(spark: SparkSession, directory: str, pattern: str = "*.parquet",
                table: str = "documents", max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over ``directory/pattern``: each new matching file is a batch."""
    d = directory.rstrip("/")
    reader = spark.readStream.schema(SCHEMAS[table]).option("basePath", d)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{d}/{pattern}")


def detect_stream(stream: DataFrame, cfg: WatermarkConfig, id_col: str, text_col: str = "text",
                  done: DataFrame | None = None) -> DataFrame:
    """Streaming detection; ``done`` (a static table of ids) is anti-joined first."""
    src = stream.select(id_col, text_col)
    if done is not None:
        src = src.join(done.select(id_col), id_col, "left_anti")
    return detect_text(src, cfg, text_col)


def idempotent_sink(out_path: str, run: str | None = None):
    """foreachBatch function (X3): a batch goes to the folder of its run and epoch, with
    overwrite, so a batch that is run again replaces its earlier attempt. The run is ``run``,
    else the query's id from its checkpoint."""
    root, fallback = out_path.rstrip("/"), uuid.uuid4().hex[:12]

    def write(batch: DataFrame, epoch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{root}/_run={run or query or fallback}/_epoch={int(epoch_id)}")
    return write


def scoring_sink(cfg: WatermarkConfig, id_col: str, text_col: str, out_path: str, columns=None,
                 run: str | None = None):
    """foreachBatch function that scores each micro-batch and writes it to its epoch
    folder. A micro-batch is an ordinary DataFrame here, so the parallelism guard of
    batch scans applies: a batch read from one large file is spread over the task
    slots; a batch with enough input splits is scored where it was read."""
    from greenscan.sources.tables import spread
    store = idempotent_sink(out_path, run)

    def write(batch: DataFrame, epoch_id: int) -> None:
        scored = detect_text(spread(batch.select(id_col, text_col)), cfg, text_col)
        if columns:
            scored = scored.select(*columns)
        store(scored, epoch_id)
    return write


def run_to_completion(scored: DataFrame, out_path: str, checkpoint: str, timeout_s: int | None = None,
                      sink=None) -> None:
    """Process everything available now, then stop (trigger availableNow). There is no time
    limit unless ``timeout_s`` sets one. ``sink`` replaces the plain epoch writer (e.g.
    :func:`scoring_sink`)."""
    q = (scored.writeStream.foreachBatch(sink or idempotent_sink(out_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise q.exception()


def results(spark: SparkSession, out_path: str) -> DataFrame:
    """All epochs of the sink (the epoch folder name is not a result column)."""
    return spark.read.parquet(out_path).drop("_run", "_epoch")


def skip_done_stream(stream: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Stream-static anti join against the ids scored before the stream (X2), for example
    those of :func:`results` when a stream starts over without its checkpoint. Rows without an
    id stay."""
    return stream.join(done.select(F.col(id_col)), id_col, "left_anti")


__all__ = ["read_stream", "detect_stream", "idempotent_sink", "scoring_sink", "skip_done_stream", "skip_seen",
           "run_to_completion", "results"]
