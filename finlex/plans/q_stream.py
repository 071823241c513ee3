"""Streaming queries (R1, R2, R4, R5): each runs its stream to completion
(``availableNow``) and returns the table the stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import validate as V
from ..sources import fixtures as FX
from ..streaming import stream as ST
from .q_meta import HIST_SQL
from .registry import register

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
ORDER_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                "o_orderdate TIMESTAMP, o_orderpriority STRING")
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _process_documents(batch):
    v = V.validate_documents(batch.select("doc_id", "text"))
    n = TX.normalize("clean_text")
    return v.select("doc_id", "error_code", F.size(TX.words(n)).cast("bigint").alias("word_count"))


def _run_document_stream(spark, sf):
    out = ST.work_dir(spark, "documents")
    q = ST.run_batches(ST.table_stream(spark, sf, DOC_SCHEMA, "documents.parquet"), _process_documents, out)
    q.awaitTermination()
    return out


_WORDS = ("len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'),"
          " '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))")


@register("R1_document_stream", f"""
SELECT doc_id, CASE WHEN length(text) < 1 THEN 'TEXT_TOO_SHORT' END AS error_code,
  CAST(CASE WHEN length(text) < 1 THEN 0 ELSE {_WORDS} END AS BIGINT) AS word_count FROM documents""")
def r1_stream(spark, sf):
    out = _run_document_stream(spark, sf)
    return spark.read.parquet(f"{out}/results").drop("batch_id")


@register("R2_R3_stream_statistics", """
SELECT CAST(count(*) AS BIGINT) AS texts, CAST(sum(CASE WHEN length(text) < 1 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  round(1 - sum(CASE WHEN length(text) < 1 THEN 1 ELSE 0 END) / count(*), 6) AS success_rate FROM documents""")
def r2_stats(spark, sf):
    out = _run_document_stream(spark, sf)
    s = ST.stream_statistics(spark, out)
    return s.select(F.col("texts").cast("bigint").alias("texts"), F.col("errors").cast("bigint").alias("errors"),
                    F.round("success_rate", 6).alias("success_rate"))


@register("R4_online_weights", HIST_SQL + "SELECT model, round(weight, 6) AS weight FROM wts")
def r4_weights(spark, sf):
    orders = ST.table_stream(spark, sf, ORDER_SCHEMA, "orders.parquet")
    a = FX.ann(spark, sf, orders=orders)
    pl = FX.preds_long(spark, sf, a)
    outcomes = pl.filter(F.col("class") == F.col("predicted_class")).select(
        "model", "predicted_class", "confidence",
        F.when(F.col("doc_id") % 3 != 0, F.col("true_class")).alias("true_class"))
    out = ST.work_dir(spark, "weights")
    ST.online_weights(outcomes, out).awaitTermination()
    return spark.read.parquet(f"{out}/weights").select("model", F.round("weight", 6).alias("weight"))


@register("R5_bounded_history_state", """
SELECT user_id, ts, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def r5_history(spark, sf):
    ev = ST.table_stream(spark, sf, EVENT_SCHEMA, "events.parquet")
    out = ST.work_dir(spark, "history")
    ST.run_history(ev, out, 5).awaitTermination()
    return ST.current_history(spark, out)
