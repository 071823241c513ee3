"""Meta-learning over prediction history.

History is a table ``(doc_id, model, predicted_class, confidence, true_class)``
(``true_class`` null when the outcome is unknown).  Every statistic is an
aggregation keyed by (model, class): bounded output, partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WEIGHT = 1.0
STRENGTH_CAP = 10
HISTORY_SIZE = 200
MIN_STACKING_ROWS = 50


def accuracy_matrix(history: DataFrame) -> DataFrame:
    """M1: per (model, predicted_class) correct and total over rows with an outcome."""
    h = history.filter(F.col("predicted_class").isNotNull() & F.col("true_class").isNotNull())
    return h.groupBy("model", "predicted_class").agg(
        F.sum((F.col("predicted_class") == F.col("true_class")).cast("long")).alias("correct"),
        F.count(F.lit(1)).alias("total"))


def confidence_matrix(history: DataFrame) -> DataFrame:
    """M2: per (model, predicted_class) mean reported confidence and sample count."""
    return history.filter(F.col("predicted_class").isNotNull()).groupBy("model", "predicted_class").agg(
        F.avg(F.coalesce(F.col("confidence"), F.lit(0.5))).alias("conf_mean"), F.count(F.lit(1)).alias("samples"))


def with_feedback(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """M3: explicit feedback rows (model, predicted_class, true_class) appended."""
    return history.unionByName(feedback, allowMissingColumns=True)


def model_class_stats(history: DataFrame) -> DataFrame:
    """M1 and M2 side by side: ``(model, class, correct, total, conf_mean, samples)``."""
    return confidence_matrix(history).join(accuracy_matrix(history), ["model", "predicted_class"], "full") \
        .withColumnRenamed("predicted_class", "class")


def model_weights(stats: DataFrame) -> DataFrame:
    """M4: weight = a / (a + b); a = 1 + Σ correct, b = 1 + Σ wrong over classes with
    outcomes; confidence-only classes add conf·min(n, 10) and (1-conf)·min(n, 10)."""
    has_truth = F.coalesce(F.col("total"), F.lit(0)) > 0
    strength = F.least(F.col("samples"), F.lit(STRENGTH_CAP))
    a = F.when(has_truth, F.col("correct")).when(F.col("samples") > 0, F.col("conf_mean") * strength).otherwise(0.0)
    b = F.when(has_truth, F.col("total") - F.col("correct")) \
        .when(F.col("samples") > 0, (1 - F.col("conf_mean")) * strength).otherwise(0.0)
    g = stats.groupBy("model").agg((1 + F.sum(a)).alias("alpha"), (1 + F.sum(b)).alias("beta"))
    return g.select("model", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("weight"))


def weight_in_context(stats: DataFrame, weights: DataFrame, contexts: DataFrame) -> DataFrame:
    """M5: ``contexts(model, category)`` -> class accuracy (or mean confidence) for that
    category, else the model weight, else 1.0."""
    s = stats.select("model", F.col("class").alias("category"), "correct", "total", "conf_mean")
    j = contexts.join(s, ["model", "category"], "left").join(weights, "model", "left")
    specific = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.col("conf_mean"))
    return j.select("model", "category", F.coalesce(specific, F.col("weight"), F.lit(DEFAULT_WEIGHT)).alias("weight"))


def weighted_vote(probs_long: DataFrame, weights: DataFrame) -> DataFrame:
    """M6: per class Σ p·w / Σ w over the models reporting it; argmax (ties by class).

    ``probs_long``: (doc_id, model, class, prob).  Documents without usable
    probabilities (all null) stay and get ``unknown`` / 0.
    """
    j = probs_long.join(F.broadcast(weights), "model", "left") \
        .withColumn("w", F.when(F.col("prob").isNotNull(), F.coalesce("weight", F.lit(DEFAULT_WEIGHT))))
    per = j.groupBy("doc_id", "class").agg((F.sum(F.col("prob") * F.col("w")) / F.sum("w")).alias("p"))
    rank = F.when(F.col("p").isNotNull(), F.struct(-F.col("p"), F.col("class")))
    best = per.groupBy("doc_id").agg(F.min_by("class", rank).alias("c"), F.max("p").alias("p"))
    return best.select("doc_id", F.coalesce(F.col("c"), F.lit("unknown")).alias("predicted_class"),
                       F.coalesce(F.col("p"), F.lit(0.0)).alias("confidence"))


def rule_stacking(preds: DataFrame) -> DataFrame:
    """M7: each specialist decides its own dimension; mean of confidences > 0."""
    w = preds.groupBy("doc_id").pivot("model", ["type_classifier", "sentiment_analyzer", "impact_modeler"]).agg(
        F.first("predicted_class").alias("c"), F.first("confidence").alias("p"))
    confs = F.array(*[F.coalesce(F.col(f"{m}_p"), F.lit(0.0))
                      for m in ["type_classifier", "sentiment_analyzer", "impact_modeler"]])
    pos = F.filter(confs, lambda x: x > 0)
    return w.select("doc_id", F.coalesce("type_classifier_c", F.lit("unknown")).alias("type"),
                    F.coalesce("sentiment_analyzer_c", F.lit("neutral")).alias("sentiment"),
                    F.coalesce("impact_modeler_c", F.lit("medium")).alias("impact"),
                    F.when(F.size(pos) > 0, F.aggregate(pos, F.lit(0.0), lambda a, x: a + x) / F.size(pos))
                    .otherwise(0.0).alias("overall_confidence"))


def stacking_features(probs_long: DataFrame, model_classes: dict[str, list[str]]) -> DataFrame:
    """M8: confidence per model (default 0.5) and per-class probabilities (default 0)."""
    pairs = [(m, c) for m, cs in model_classes.items() for c in cs]
    p = probs_long.withColumn("mc", F.concat_ws("__", "model", "class"))
    wide = p.groupBy("doc_id").pivot("mc", [f"{m}__{c}" for m, c in pairs]).agg(F.first("prob"))
    conf = probs_long.groupBy("doc_id").pivot("model", list(model_classes)).agg(F.max("prob"))
    conf = conf.select("doc_id", *[F.coalesce(F.col(m), F.lit(0.5)).alias(f"{m}__confidence") for m in model_classes])
    wide = wide.select("doc_id", *[F.coalesce(F.col(f"{m}__{c}"), F.lit(0.0)).alias(f"{m}__{c}") for m, c in pairs])
    return conf.join(wide, "doc_id")


def train_stacker(features: DataFrame, label_col: str = "label", max_iter: int = 100):
    """M9: StandardScaler + multinomial LogisticRegression; None below 50 rows."""
    n = features.limit(MIN_STACKING_ROWS).count()
    if n < MIN_STACKING_ROWS:
        return None
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    cols = [c for c in features.columns if c not in ("doc_id", label_col)]
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=cols, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial", maxIter=max_iter)])
    return pipe.fit(features)


def stacked_predict(model, features: DataFrame, fallback: DataFrame) -> DataFrame:
    """The trained stacker's class, or rule stacking (M7) when there is no model."""
    if model is None:
        return fallback.select("doc_id", F.col("sentiment").alias("predicted"), F.lit("rules").alias("method"))
    labels = model.stages[0].labels
    out = model.transform(features)
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return out.select("doc_id", lab.alias("predicted"), F.lit("stacking").alias("method"))


def last_n(df: DataFrame, order: list[Column], n: int = HISTORY_SIZE) -> DataFrame:
    """The ``n`` most recent rows by arrival order (distributed top-k)."""
    return df.orderBy(*order).limit(n)
