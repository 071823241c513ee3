"""Queries for meta-learning (M1-M11) over the ``preds`` history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayesnet as BN
from ..operators import meta as MT
from ..session import materialize
from ..sources import fixtures as FX
from ..sources import tables as S
from .registry import register

R = 6


def _r(df):
    return df.select(*[F.round(F.col(f.name), R).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _history(spark, sf):
    """Prediction history; the outcome is known for two orders in three."""
    p = FX.preds_base(spark, sf).select("doc_id", "model", "predicted_class", "confidence", "true_class")
    return p.withColumn("true_class", F.when(F.col("doc_id") % 3 != 0, F.col("true_class")))


def _feedback(spark, sf):
    p = FX.preds_base(spark, sf).select("doc_id", "model", "predicted_class", "true_class")
    return p.filter((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 17 == 0)) \
        .select("model", "predicted_class", "true_class")


HIST_SQL = FX.ctes("preds_long") + """,
hist AS (SELECT DISTINCT doc_id, model, predicted_class, confidence,
  CASE WHEN doc_id % 3 <> 0 THEN true_class END AS true_class FROM preds_long),
m1 AS (SELECT model, predicted_class, CAST(sum(CASE WHEN predicted_class = true_class THEN 1 ELSE 0 END) AS BIGINT)
  AS correct, CAST(count(*) AS BIGINT) AS total FROM hist WHERE true_class IS NOT NULL GROUP BY ALL),
m2 AS (SELECT model, predicted_class, avg(coalesce(confidence, 0.5)) AS conf_mean, CAST(count(*) AS BIGINT) AS samples
  FROM hist GROUP BY ALL),
st AS (SELECT coalesce(m2.model, m1.model) AS model, coalesce(m2.predicted_class, m1.predicted_class) AS class,
  correct, total, conf_mean, samples FROM m2 FULL JOIN m1 ON m1.model = m2.model AND m1.predicted_class = m2.predicted_class),
wts AS (SELECT model, (1 + sum(CASE WHEN coalesce(total, 0) > 0 THEN correct WHEN samples > 0
    THEN conf_mean * least(samples, 10) ELSE 0 END)) / ((1 + sum(CASE WHEN coalesce(total, 0) > 0 THEN correct
    WHEN samples > 0 THEN conf_mean * least(samples, 10) ELSE 0 END)) + (1 + sum(CASE WHEN coalesce(total, 0) > 0
    THEN total - correct WHEN samples > 0 THEN (1 - conf_mean) * least(samples, 10) ELSE 0 END))) AS weight
  FROM st GROUP BY model)
"""


@register("M1_accuracy_matrix", HIST_SQL + "SELECT * FROM m1")
def m1_accuracy(spark, sf):
    return MT.accuracy_matrix(_history(spark, sf))


@register("M2_confidence_matrix", HIST_SQL + f"""
SELECT model, predicted_class, round(conf_mean, {R}) AS conf_mean, samples FROM m2""")
def m2_confidence(spark, sf):
    return _r(MT.confidence_matrix(_history(spark, sf)))


@register("M3_feedback", HIST_SQL + """
, fb AS (SELECT DISTINCT doc_id, model, predicted_class, true_class FROM preds_long
  WHERE doc_id % 3 = 0 AND doc_id % 17 = 0),
h2 AS (SELECT model, predicted_class, true_class FROM hist UNION ALL SELECT model, predicted_class, true_class FROM fb)
SELECT model, predicted_class, CAST(sum(CASE WHEN predicted_class = true_class THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(count(*) AS BIGINT) AS total FROM h2 WHERE true_class IS NOT NULL GROUP BY ALL""")
def m3_feedback(spark, sf):
    h = _history(spark, sf).select("model", "predicted_class", "true_class")
    return MT.accuracy_matrix(MT.with_feedback(h, _feedback(spark, sf)))


@register("M4_model_weights", HIST_SQL + f"SELECT model, round(weight, {R}) AS weight FROM wts")
def m4_weights(spark, sf):
    return _r(MT.model_weights(MT.model_class_stats(_history(spark, sf))))


@register("M5_weight_in_context", HIST_SQL + f"""
, ctx AS (SELECT DISTINCT model, true_class AS category FROM hist WHERE true_class IS NOT NULL
  UNION SELECT DISTINCT model, 'unseen' FROM hist)
SELECT c.model, c.category, round(coalesce(CASE WHEN s.total > 0 THEN s.correct / s.total ELSE s.conf_mean END,
  w.weight, 1.0), {R}) AS weight
FROM ctx c LEFT JOIN st s ON s.model = c.model AND s.class = c.category LEFT JOIN wts w ON w.model = c.model""")
def m5_context(spark, sf):
    h = _history(spark, sf)
    stats = MT.model_class_stats(h)
    ctx = h.filter(F.col("true_class").isNotNull()).select("model", F.col("true_class").alias("category")) \
        .unionByName(h.select("model", F.lit("unseen").alias("category"))).distinct()
    return _r(MT.weight_in_context(stats, MT.model_weights(stats), ctx))


@register("M6_weighted_vote", HIST_SQL + f"""
, pc AS (SELECT p.doc_id, p.class, sum(p.prob * coalesce(w.weight, 1.0)) / sum(coalesce(w.weight, 1.0)) AS p
  FROM preds_long p LEFT JOIN wts w USING (model) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class) AS rn FROM pc)
SELECT doc_id, class AS predicted_class, round(p, {R}) AS confidence FROM b WHERE rn = 1""")
def m6_vote(spark, sf):
    w = MT.model_weights(MT.model_class_stats(_history(spark, sf)))
    pl = FX.preds_long(spark, sf).select("doc_id", "model", "class", "prob")
    return _r(MT.weighted_vote(pl, w))


@register("M7_rule_stacking", HIST_SQL + f"""
SELECT doc_id, max(CASE WHEN model = 'type_classifier' THEN predicted_class END) AS type,
  max(CASE WHEN model = 'sentiment_analyzer' THEN predicted_class END) AS sentiment,
  max(CASE WHEN model = 'impact_modeler' THEN predicted_class END) AS impact,
  round(avg(CASE WHEN confidence > 0 THEN confidence END), {R}) AS overall_confidence
FROM hist GROUP BY doc_id""")
def m7_rules(spark, sf):
    return _r(MT.rule_stacking(_history(spark, sf)))


def _features(spark, sf):
    pl = FX.preds_long(spark, sf).select("doc_id", "model", "class", "prob")
    return MT.stacking_features(pl, FX.MODELS)


_PAIRS = [(m, c) for m, cs in FX.MODELS.items() for c in cs]


@register("M8_stacking_features", HIST_SQL + "SELECT doc_id, " + ", ".join(
    [f"round(coalesce(max(CASE WHEN model = '{m}' THEN prob END), 0.5), {R}) AS {m}__confidence" for m in FX.MODELS]
    + [f"round(coalesce(max(CASE WHEN model = '{m}' AND class = '{c}' THEN prob END), 0.0), {R}) AS {m}__{c}"
       for m, c in _PAIRS]) + " FROM preds_long GROUP BY doc_id")
def m8_features(spark, sf):
    return _r(_features(spark, sf))


def _market_truth(spark, sf):
    """Ground-truth market direction: the network decision from the true classes."""
    truth = FX.preds_base(spark, sf).select("doc_id", "model", F.col("true_class").alias("predicted_class"),
                                            F.lit(0.9).alias("confidence"))
    ev = BN.evidence(BN.mapped_outputs(truth))
    return BN.decision_table(ev, spark).select("doc_id", F.col("market_direction").alias("label"))


@register("M9_M10_stacked_prediction")
def m9_m10_stacking(spark, sf):
    """Train the stacker on the history (>= 50 rows) and predict; rows-only check."""
    feats = _features(spark, sf)
    # read by the row count, the indexer, the scaler, the regression and the prediction
    data = materialize(feats.join(_market_truth(spark, sf), "doc_id"), "stacking")
    train = data.filter(F.col("doc_id") % 5 != 0)
    model = MT.train_stacker(train)
    fallback = MT.rule_stacking(_history(spark, sf))
    return MT.stacked_predict(model, data, fallback)


@register("M11_bounded_history", f"""
SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT {MT.HISTORY_SIZE}""")
def m11_history(spark, sf):
    e = S.table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    return MT.last_n(e, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "event_type")
