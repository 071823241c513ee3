"""Model tuning and calibration jobs.

Grid search runs every (parameter, fold) combination in one job: the fold id
is a column, the parameter grid a small literal array, and the Gaussian
sufficient statistics are aggregated once per (fold, class, feature); every
fold and grid point reuses them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as EV
from . import naive_bayes as NB
from . import selection as SE
from .vocab import TermRows

# FIXED VALUES: grids of the reference's tuning.
VAR_SMOOTHING_GRID = [1e-11, 1e-10, 1e-9, 1e-8, 1e-7]
ALPHA_GRID = [0.1, 0.5, 1.0, 2.0]
NORM_GRID = [True, False]
FIT_PRIOR_GRID = [True, False]


def gaussian_grid_search(data: DataFrame | NB.FeatureRows, docs: DataFrame, k: int = 5, seed: int = 42,
                         grid: list[float] = VAR_SMOOTHING_GRID) -> DataFrame:
    """Stratified-in-expectation k folds x var_smoothing grid, weighted F1 per point.

    ``data``: (doc_id, label, feature, x), not scaled, or one column a feature: each fold is scaled
    by its own training rows.  Counts, sums and squares are taken once per (fold, class, feature); a
    fold's training statistics are the totals less its own.  Output ``(var_smoothing, f1)``
    over the held-out predictions of all folds.

    Of columns, each document's row is scored for all points at once; rows that share a document and
    label are one document whose densities add up, so with such rows the long form is taken.
    """
    if isinstance(data, NB.FeatureRows):
        if data.wide.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            points = data.wide.sparkSession.createDataFrame([(v,) for v in grid], "var_smoothing DOUBLE")
            found = SE.gaussian_grid(data.wide, data.features, k, seed, grid, [len(data.features)])
            return points.join(F.broadcast(found.select("var_smoothing", "f1")), "var_smoothing", "left")
        data = data.long()
    folds = EV.kfold(docs.select("doc_id", "label"), k, seed).select("doc_id", "label", "fold")
    lf = EV.kfold(data, k, seed)
    held = F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("held")
    x2 = F.sum(F.col("x") * F.col("x"))
    per = lf.groupBy("fold", "label", "feature").agg(F.count("x").alias("n"), F.sum("x").alias("s"), x2.alias("q"))
    per = per.checkpoint()  # folds x classes x features rows
    own = per.withColumnRenamed("fold", "held")
    tot = per.groupBy("label", "feature").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    tr = tot.select("*", held).join(own, ["held", "label", "feature"], "left").select(
        "held", "label", "feature", *[(F.col(f"t{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "s", "q")]).filter("n > 0")

    def spread(n, s, q):
        return F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))

    scaler = tr.groupBy("held", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]) \
        .withColumn("v", spread(F.col("n"), F.col("s"), F.col("q"))).select(
            "held", "feature", (F.col("s") / F.col("n")).alias("sm"), "v",
            F.when(F.col("v") > 1e-18, F.sqrt("v")).otherwise(1.0).alias("ss"))
    stats = tr.join(scaler.drop("v"), ["held", "feature"]).select(
        "held", "label", "feature", ((F.col("s") / F.col("n") - F.col("sm")) / F.col("ss")).alias("mean"),
        (spread(F.col("n"), F.col("s"), F.col("q")) / (F.col("ss") * F.col("ss"))).alias("v0"))
    maxvar = scaler.groupBy("held").agg(F.max(F.col("v") / (F.col("ss") * F.col("ss"))).alias("maxv"))
    counts = folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    labels = counts.groupBy("label").agg(F.sum("c").alias("t"))
    prior = labels.select("label", "t", held).join(counts.withColumnRenamed("fold", "held"), ["held", "label"], "left") \
        .withColumn("n", F.col("t") - F.coalesce("c", F.lit(0))).filter("n > 0") \
        .withColumn("log_prior", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("held"))))
    g = F.explode(F.array(*[F.lit(v) for v in grid])).alias("vs")
    model = stats.join(maxvar, "held").select("*", g).withColumn("var", F.col("v0") + F.col("vs") * F.col("maxv"))
    test = lf.withColumnRenamed("fold", "held").withColumnRenamed("label", "true_label") \
        .join(F.broadcast(scaler.select("held", "feature", "sm", "ss")), ["held", "feature"]) \
        .withColumn("x", (F.col("x") - F.col("sm")) / F.col("ss"))
    scored = test.join(F.broadcast(model.select("held", "vs", "label", "feature", "mean", "var")), ["held", "feature"])
    jll = scored.groupBy("held", "vs", "doc_id", "true_label", "label").agg(
        F.sum(-0.5 * F.log(2 * math.pi * F.col("var")) - 0.5 * F.pow(F.col("x") - F.col("mean"), 2) / F.col("var"))
        .alias("s")).join(F.broadcast(prior.select("held", "label", "log_prior")), ["held", "label"]) \
        .withColumn("j", F.col("s") + F.col("log_prior"))
    best = jll.groupBy("held", "vs", "doc_id", "true_label").agg(
        F.min_by("label", F.struct(-F.col("j"), F.col("label"))).alias("predicted_class"))
    res = []
    for v in grid:
        m = EV.classification_metrics(best.filter(F.col("vs") == v).withColumnRenamed("true_label", "label"))
        res.append(m.select(F.lit(v).alias("var_smoothing"), "f1"))
    out = res[0]
    for r in res[1:]:
        out = out.unionByName(r)
    return out


def complement_grid_search(train_w: DataFrame | TermRows, train_docs: DataFrame, valid_w: DataFrame | TermRows, valid_docs: DataFrame,
                           vocab: DataFrame) -> DataFrame:
    """Alpha x norm x fit_prior (16 points), validation weighted F1 each.

    The weights are added up per class once, for all fits.  ``TermRows`` (``valid_w`` with the label kept)
    are scored with all models in one pass.
    """
    sums = NB.label_sums(train_w).withColumnRenamed("x", "w").checkpoint()  # classes x terms rows
    labels = train_docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    points = [(alpha, norm) for alpha in ALPHA_GRID for norm in NORM_GRID]
    models = [NB.complement_fit(sums, labels.select("label"), vocab, alpha=alpha, norm=norm) for alpha, norm in points]
    classes = models[0].classes
    width = len(classes)
    if isinstance(valid_w, TermRows) and sum(m.weights.count() for m in models) <= NB.BROADCAST_WEIGHTS:
        scored = NB.complement_sums(models, valid_w).select(F.col("label").alias("t"), *[f"_s{i}" for i in range(width * len(points))])
        said = [SE._first_best([F.col(f"_s{p * width + i}") for i in range(width)], classes) for p in range(len(points))]
    else:
        rows = valid_w.drop("label").long() if isinstance(valid_w, TermRows) else valid_w
        pred = [NB.complement_score(m, rows, valid_docs.select("doc_id")).select("doc_id", F.col("predicted_class").alias(f"_p{p}"))
                for p, m in enumerate(models)]
        scored = reduce(lambda a, b: a.join(b, "doc_id"), pred, valid_docs.select("doc_id", F.col("label").alias("t")))
        said = [F.col(f"_p{p}") for p in range(len(points))]
    said = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(norm).alias("norm"), c.alias("p")) for (a, norm), c in zip(points, said)])
    counts = scored.select("t", F.inline(said)).groupBy("alpha", "norm", "t", "p").agg(F.count(F.lit(1)).alias("c"))
    grid = vocab.sparkSession.createDataFrame([(a, norm, fp) for a, norm in points for fp in FIT_PRIOR_GRID],
                                              "alpha DOUBLE, norm BOOLEAN, fit_prior BOOLEAN")
    # with several classes the prior does not enter the score
    return grid.join(F.broadcast(SE.weighted_f1(counts, ["alpha", "norm"]).select("alpha", "norm", "f1")), ["alpha", "norm"], "left") \
        .select("alpha", "norm", "fit_prior", "f1")


def sigmoid_calibration(probs_long: DataFrame, max_iter: int = 50) -> DataFrame:
    """One-vs-rest logistic calibration on each class's log-odds, renormalised.

    ``probs_long``: (doc_id, class, prob, true_class) from a held-out split.
    Returns ``(doc_id, class, calibrated)``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    eps = 1e-12
    x = probs_long.withColumn("logit", F.log((F.col("prob") + eps) / (1 - F.col("prob") + eps))) \
        .withColumn("y", (F.col("class") == F.col("true_class")).cast("double"))
    classes = [r[0] for r in x.select("class").distinct().collect()]  # the model's classes
    parts = []
    for c in sorted(classes):
        xc = VectorAssembler(inputCols=["logit"], outputCol="f").transform(x.filter(F.col("class") == c))
        m = LogisticRegression(featuresCol="f", labelCol="y", maxIter=max_iter).fit(xc)
        w, b = float(m.coefficients[0]), float(m.intercept)
        parts.append(x.filter(F.col("class") == c).select(
            "doc_id", "class", (1 / (1 + F.exp(-(F.col("logit") * w + b)))).alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("calibrated", F.col("s") / F.sum("s").over(Window.partitionBy("doc_id"))).drop("s")


def lda_topics(vectors: DataFrame, k: int = 20, max_iter: int = 10, seed: int = 42):
    """L23 (declared in the reference): LDA over sparse term-count vectors."""
    from pyspark.ml.clustering import LDA
    vec = vectors.withColumnRenamed("text_vector", "features")
    return LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online").fit(vec), vec


def timed_scoring(pred: DataFrame):
    """Scoring statistics (count) observed while the predictions are written;
    wall time is measured around the action by the caller."""
    from pyspark.sql import Observation
    obs = Observation("scoring")
    return pred.observe(obs, F.count(F.lit(1)).alias("predictions")), obs
