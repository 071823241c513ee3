"""Structured Streaming operators.

* R1-R3: a file stream of documents runs the batch operators per micro-batch
  inside ``foreachBatch``; every batch writes its result and one statistics
  row under its batch id, so a batch that is run again replaces itself; a
  failing batch is counted as errors and the stream continues.
* R4: online model weights from an outcome stream: a streaming aggregation
  keyed by (model, class) in complete mode, weights recomputed per batch.
* R5: bounded per-key history kept as state (``applyInPandasWithState``, RocksDB
  state store), capped at N rows per key; each batch writes the histories it
  changed under its batch id, and a key's newest batch holds its history.

Sinks and checkpoints live under the session's ``spark.checkpoint.dir`` (a
shared folder on a cluster), so a restarted query resumes from its offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import meta as MT
from ..session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:8]}"


def table_stream(spark: SparkSession, directory: str, schema: str, glob: str = "*.parquet",
                 max_files_per_trigger: int = 1) -> DataFrame:
    """R1 source: Parquet files arriving in ``directory`` (matching ``glob``).

    ``glob`` may also name one table of ``directory``, which is a file or a folder of part files.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if not any(c in glob for c in "*?[{"):
        return files.parquet(f"{directory.rstrip('/')}/{{{glob}}}")  # as a pattern, a single file is allowed too
    return files.option("pathGlobFilter", glob).parquet(directory)


def run_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out_dir: str,
                error_col: str = "error_code", callback: Callable[[DataFrame, int], None] | None = None,
                available_now: bool = True):
    """Process each micro-batch, write its results and a statistics row.

    All folders are partitioned by ``batch_id`` and overwritten, so running a
    batch again after a restart leaves no second copy.  A batch whose processing
    fails is recorded with all its texts as errors (its raw rows go to
    quarantine) and the stream keeps going; ``callback`` runs on the written
    results, outside that rule: its failure stops the stream.
    """
    spark = stream.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        at = f"batch_id={batch_id}"
        n = batch.count()
        written = None
        try:
            process(batch).write.mode("overwrite").parquet(f"{out_dir}/results/{at}")
        except Exception:  # noqa: BLE001 - R3: count the batch as failed, keep the stream alive
            batch.write.mode("overwrite").parquet(f"{out_dir}/quarantine/{at}")
            errors = n
        else:
            written = spark.read.parquet(f"{out_dir}/results/{at}")
            errors = written.filter(F.col(error_col).isNotNull()).count() if error_col in written.columns else 0
        spark.createDataFrame([(int(n), int(errors))], "texts BIGINT, errors BIGINT") \
            .write.mode("overwrite").parquet(f"{out_dir}/stats/{at}")
        if callback is not None and written is not None:
            callback(written, batch_id)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{out_dir}/_checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_statistics(spark: SparkSession, out_dir: str) -> DataFrame:
    """R2: batches, texts, errors and success rate = 1 - errors / texts."""
    s = spark.read.parquet(f"{out_dir}/stats")
    return s.agg(F.count(F.lit(1)).alias("batches"), F.sum("texts").alias("texts"), F.sum("errors").alias("errors")) \
        .withColumn("success_rate", F.when(F.col("texts") > 0, 1 - F.col("errors") / F.col("texts")).otherwise(1.0))


def online_weights(outcomes: DataFrame, out_dir: str, available_now: bool = True):
    """Streaming (model, class) statistics in complete mode; M4 weights per batch.

    ``outcomes``: stream of (model, predicted_class, confidence, true_class).
    The aggregation state is bounded by models x classes.
    """
    agg = outcomes.groupBy("model", "predicted_class").agg(
        F.sum((F.col("predicted_class") == F.col("true_class")).cast("long")).alias("correct"),
        F.count(F.col("true_class")).alias("total"),
        F.avg(F.coalesce(F.col("confidence"), F.lit(0.5))).alias("conf_mean"),
        F.count(F.lit(1)).alias("samples"))

    def per_batch(stats: DataFrame, batch_id: int) -> None:
        st = stats.withColumnRenamed("predicted_class", "class")
        MT.model_weights(st).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{out_dir}/weights")

    w = agg.writeStream.outputMode("complete").foreachBatch(per_batch) \
        .option("checkpointLocation", f"{out_dir}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


HISTORY_STATE = "items ARRAY<STRUCT<ts: TIMESTAMP, event_id: BIGINT, event_type: STRING>>"
HISTORY_OUT = "user_id BIGINT, ts TIMESTAMP, event_id BIGINT, event_type STRING"


def bounded_history(events: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` events per user kept as state; emits the current history.

    The function sees each key's rows as an iterator of Arrow-sized chunks and
    keeps only the newest ``n``, so a hot key never materialises in full.
    """
    def keep_last(key, chunks, state):
        cur = pd.DataFrame(state.get[0] if state.exists else [], columns=["ts", "event_id", "event_type"])
        for pdf in chunks:
            part = pdf[["ts", "event_id", "event_type"]]
            cur = part if cur.empty else pd.concat([cur, part], ignore_index=True)
            cur = cur.sort_values(["ts", "event_id"], ascending=False).head(n)
        state.update(([tuple(r) for r in cur.itertuples(index=False)],))
        out = cur.assign(user_id=key[0])[["user_id", "ts", "event_id", "event_type"]]
        yield out

    return events.groupBy("user_id").applyInPandasWithState(
        keep_last, HISTORY_OUT, HISTORY_STATE, "update", GroupStateTimeout.NoTimeout)


def run_history(events_stream: DataFrame, out_dir: str, n: int = 5):
    """R5 driver: each batch writes the histories of the users it saw."""
    events_stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hist = bounded_history(events_stream, n)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/history/batch_id={batch_id}")

    return hist.writeStream.outputMode("update").foreachBatch(per_batch) \
        .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start()


def current_history(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every user's history as of the newest batch that had the user."""
    h = spark.read.parquet(f"{out_dir}/history")
    newest = h.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))
    return h.join(newest, ["user_id", "batch_id"], "left_semi").drop("batch_id")
