"""Naive Bayes models as relational model tables.

Fit = aggregations keyed by (class, term|feature): partial aggregation on the
map side, output bounded by classes x vocabulary (or features).  Score of the
text models = a table with one row per term and an array of class weights joined
to (doc, term) rows, then one aggregation keyed by ``doc_id`` producing one
column per class, and an in-row softmax; of the Gaussian model = array products
over the rows' own columns.
The class list is read from the (tiny) class table; it is bounded by the number
of labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vocab import TermRows


def class_list(labels: DataFrame, col: str = "label") -> list[str]:
    """Distinct class labels, sorted (the class order used for ties).

    Bounded by the number of classes; checked so a mistaken high-cardinality
    column fails instead of flooding the driver.
    """
    rows = labels.select(col).distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 classes: not a label column")
    return sorted(r[0] for r in rows if r[0] is not None)


def softmax_columns(df: DataFrame, classes: list[str], jll: list[str], keep: list[str]) -> DataFrame:
    """In-row softmax over per-class joint log-likelihood columns.

    Adds ``predicted_class`` (first class in order on ties), ``confidence`` and
    ``probabilities MAP<STRING,DOUBLE>``.
    """
    m = F.greatest(*[F.col(c) for c in jll]) if len(jll) > 1 else F.col(jll[0])
    ex = [F.exp(F.col(c) - m) for c in jll]
    z = ex[0]
    for e in ex[1:]:
        z = z + e
    probs = [(e / z) for e in ex]
    pred = None
    for c, col in zip(classes, jll):
        cond = F.col(col) == m
        pred = F.when(cond, F.lit(c)) if pred is None else pred.when(cond, F.lit(c))
    out = df.select(*keep, *[p.alias(f"_p{i}") for i, p in enumerate(probs)], pred.alias("predicted_class"))
    pmap = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]),
                             F.array(*[F.col(f"_p{i}") for i in range(len(classes))]))
    conf = F.greatest(*[F.col(f"_p{i}") for i in range(len(classes))]) if len(classes) > 1 else F.col("_p0")
    return out.select(*keep, "predicted_class", conf.alias("confidence"), pmap.alias("probabilities"))


def probabilities_long(pred: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Wide prediction -> long ``(doc_id, class, prob)``."""
    return pred.select(*keep, F.explode("probabilities").alias("class", "prob"))


# A term's weights go to every executor while the model has at most so many of them (16 MB);
# a larger model is joined by a shuffle on the term.
BROADCAST_WEIGHTS = 2_000_000


def label_sums(train: DataFrame | TermRows, x: Column | None = None) -> DataFrame:
    """(label, term, x): sums of the weights ``w`` (of ``x`` if given) over a label's (doc, term) rows, or over documents' rows."""
    if isinstance(train, TermRows):
        return train.label_sums()
    return train.groupBy("label", "term").agg(F.sum(F.col("w") if x is None else x).alias("x"))


def _weight_maps(model: DataFrame, classes: list[str], value: str) -> list[dict[str, float]]:
    """Per class its terms' weights; of a model of at most ``BROADCAST_WEIGHTS``."""
    of: dict[str, dict[str, float]] = {c: {} for c in classes}
    for r in model.select("label", "term", F.col(value).alias("v")).collect():
        if r.label in of:
            of[r.label][r.term] = r.v
    return [of[c] for c in classes]


def _term_scores(rows: DataFrame | TermRows, docs: DataFrame, classes: list[str], model: DataFrame, value: str, x: Column,
                 base: dict[str, float]) -> DataFrame:
    """Per document and class ``base`` plus Σ x · weight over its (doc, term) rows, one column per class.

    ``model`` (label, term, value) becomes one row a term with an array of class
    weights, so scoring keeps one row per (doc, term).  Those are summed before the
    one shuffle by doc_id, which carries a row per document and task.  ``TermRows`` are all of
    ``docs``, one row each: they are summed in the row and nothing is shuffled.
    """
    if isinstance(rows, TermRows):
        if model.count() <= BROADCAST_WEIGHTS:
            return rows.products(_weight_maps(model, classes, value), [base.get(c, 0.0) for c in classes])
        rows = rows.long().withColumn("_x", F.col("w"))
    per_term = model.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", value))).alias("_m")) \
        .select("term", F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.col("_m")[c]).alias("_w"))
    if model.count() <= BROADCAST_WEIGHTS:
        per_term = F.broadcast(per_term)
    zero = docs.select("doc_id", *[F.lit(base.get(c, 0.0)).alias(f"_s{i}") for i, c in enumerate(classes)])
    contrib = rows.join(per_term, "term").select(
        "doc_id", *[(x * F.col("_w")[i]).alias(f"_s{i}") for i in range(len(classes))])
    return zero.unionByName(contrib).groupBy("doc_id").agg(
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(classes))])


# ---------------------------------------------------------------- Bernoulli (L2, L3)

@dataclass
class BernoulliModel:
    classes: list[str]
    prior: DataFrame      # (label, n_docs, log_prior)
    theta: DataFrame      # (label, term, log_p, log_1mp)


def bernoulli_fit(train_terms: DataFrame | TermRows, train_docs: DataFrame, vocab: DataFrame,
                  alpha: float = 1.0, fit_prior: bool = True) -> BernoulliModel:
    """L2: log P(term|c) = ln((n_ct + a) / (n_c + 2a)); prior ln(n_c/N) or uniform.

    ``train_terms``: (doc_id, label, term) present terms, or documents' rows; ``train_docs``: (doc_id, label).
    """
    classes = class_list(train_docs)
    k = len(classes)
    counts = train_docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    total = F.sum("n_docs").over(Window.partitionBy())
    prior = counts.select("label", "n_docs", (F.log(F.col("n_docs") / total) if fit_prior
                                              else F.lit(-math.log(k))).alias("log_prior"))
    fc = label_sums(train_terms, F.lit(1)).select("label", "term", F.col("x").cast("bigint").alias("n_ct"))
    grid = vocab.select("term", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    theta = (grid.join(fc, ["label", "term"], "left").join(F.broadcast(counts), "label")
             .select("label", "term",
                     F.log((F.coalesce("n_ct", F.lit(0)) + alpha) / (F.col("n_docs") + 2 * alpha)).alias("log_p"),
                     F.log((F.col("n_docs") - F.coalesce("n_ct", F.lit(0)) + alpha) / (F.col("n_docs") + 2 * alpha))
                     .alias("log_1mp")))
    return BernoulliModel(classes, prior, theta.checkpoint())  # classes x terms rows, read by base, size and weights


def bernoulli_score(model: BernoulliModel, doc_terms_present: DataFrame | TermRows, docs: DataFrame) -> DataFrame:
    """L3: Σ present ln p + Σ absent ln(1-p) + prior, softmax, argmax.

    ``doc_terms_present`` holds each (doc, term) once.
    ``base_c`` = prior + Σ_vocab ln(1-p) (k numbers); the present terms add
    ln p - ln(1-p) through a broadcast join of the vocabulary-sized model.
    """
    base = (model.theta.groupBy("label").agg(F.sum("log_1mp").alias("b"))
            .join(model.prior, "label").select("label", (F.col("b") + F.col("log_prior")).alias("base")))
    delta = model.theta.select("label", "term", (F.col("log_p") - F.col("log_1mp")).alias("d"))
    present = doc_terms_present if isinstance(doc_terms_present, TermRows) else doc_terms_present.select("doc_id", "term")
    wide = _term_scores(present, docs, model.classes, delta, "d", F.lit(1.0),
                        dict(tuple(r) for r in base.collect()))  # one number a class
    return softmax_columns(wide, model.classes, [f"_s{i}" for i in range(len(model.classes))], ["doc_id"])


# ---------------------------------------------------------------- Complement

@dataclass
class ComplementModel:
    classes: list[str]
    weights: DataFrame    # (label, term, w)


def complement_fit(train_weights: DataFrame | TermRows, train_docs: DataFrame, vocab: DataFrame, alpha: float = 1.0,
                   norm: bool = True, weighting: str = "standard") -> ComplementModel:
    """L4 (``weighting='standard'``) and L5 (``'log1p_l2'``) complement weights.

    ``train_weights``: (doc_id, label, term, w) e.g. TF-IDF rows, or documents' rows of them.
    standard: comp = Σ_all + a - Σ_c; logged = ln(comp / Σ_t comp);
              w = logged / Σ_t logged when ``norm`` else -logged.
    log1p_l2: w = ln(1 + (comp_count + a·k) / comp_docs), L2-normalised per class.
    """
    classes = class_list(train_docs)
    k = len(classes)
    fc = label_sums(train_weights).withColumnRenamed("x", "fc")
    grid = vocab.select("term", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    t = grid.join(fc, ["label", "term"], "left").withColumn("fc", F.coalesce("fc", F.lit(0.0)))
    t = t.withColumn("fall", F.sum("fc").over(Window.partitionBy("term")))
    by_class = Window.partitionBy("label")
    if weighting == "standard":
        comp = F.col("fall") + alpha - F.col("fc")
        t = t.withColumn("comp", comp).withColumn("logged", F.log(F.col("comp") / F.sum("comp").over(by_class)))
        w = (F.col("logged") / F.sum("logged").over(by_class)) if norm else -F.col("logged")
    elif weighting == "log1p_l2":
        counts = train_docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
        n_all = F.sum("n_c").over(Window.partitionBy())
        comp_docs = counts.select("label", (n_all - F.col("n_c")).alias("comp_docs"))
        t = (t.join(F.broadcast(comp_docs), "label")
             .withColumn("lp", F.log1p((F.col("fall") - F.col("fc") + alpha * k) / F.col("comp_docs"))))
        w = (F.col("lp") / F.sqrt(F.sum(F.col("lp") * F.col("lp")).over(by_class))) if norm else F.col("lp")
    else:
        raise ValueError(weighting)
    return ComplementModel(classes, t.select("label", "term", w.alias("w")).checkpoint())  # classes x terms rows


def complement_score(model: ComplementModel, doc_weights: DataFrame | TermRows, docs: DataFrame) -> DataFrame:
    """jll_c = Σ_t x_t w_ct, softmax, argmax (no prior with several classes)."""
    rows = doc_weights if isinstance(doc_weights, TermRows) else doc_weights.select("doc_id", "term", F.col("w").alias("_x"))
    wide = _term_scores(rows, docs, model.classes, model.weights, "w", F.col("_x"), {})
    return softmax_columns(wide, model.classes, [f"_s{i}" for i in range(len(model.classes))], ["doc_id"])


def complement_sums(models: list[ComplementModel], doc_weights: TermRows) -> DataFrame:
    """L6 of several models in one pass: (doc_id, *keep, _s0, ...), the jll of each model's classes after those of the one before."""
    return doc_weights.products([m for x in models for m in _weight_maps(x.weights, x.classes, "w")], [0.0] * sum(len(x.classes) for x in models))


# ---------------------------------------------------------------- Gaussian

def unpivot_features(df: DataFrame, features: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Wide numeric features -> long ``(*keep, feature, x)`` (narrow)."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]) \
        .unpivot(list(keep), features, "feature", "x")


@dataclass
class FeatureRows:
    """Numeric features of documents, one column each: what fits and grids read instead of a row a feature."""
    wide: DataFrame       # (doc_id, label, one column a feature)
    features: list[str]

    def filter(self, condition: Column) -> FeatureRows:
        return FeatureRows(self.wide.filter(condition), self.features)

    def long(self) -> DataFrame:
        """``(doc_id, label, feature, x)``."""
        return unpivot_features(self.wide, self.features, keep=("doc_id", "label"))


# Features of one aggregation: mean and variance have five sums each, and Spark compiles up to 100 columns.
AT_ONCE = 13


def _moments(rows: FeatureRows, *by: str) -> DataFrame:
    """(*by, feature, n, mean, var) by aggregations of columns; each reads its own features only."""
    parts = []
    for at in range(0, len(rows.features), AT_ONCE):
        some = rows.features[at:at + AT_ONCE]
        x = [F.col(f).cast("double") for f in some]
        row = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var"))
                                 for i, f in enumerate(some)]))
        sums = rows.wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                                          *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)])
        parts.append(sums.filter("n > 0").select(*by, "n", row))
    return reduce(DataFrame.unionByName, parts)


def scaler_fit(train: DataFrame | FeatureRows) -> DataFrame:
    """Per feature mean and population std (0 -> 1). Bounded by #features."""
    s = _moments(train).select("feature", "mean", F.sqrt("var").alias("std")) if isinstance(train, FeatureRows) else \
        train.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return s.select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std"))


def scale(data: DataFrame | FeatureRows, scaler: DataFrame) -> DataFrame | FeatureRows:
    if isinstance(data, FeatureRows):
        of = {r.feature: (r["mean"], r["std"]) for r in scaler.collect()}  # one row a feature
        names = [f for f in data.features if f in of]
        others = [c for c in data.wide.columns if c not in data.features]
        return FeatureRows(data.wide.select(*others, *[((F.col(f).cast("double") - F.lit(of[f][0])) / F.lit(of[f][1])).alias(f) for f in names]), names)
    return data.join(F.broadcast(scaler), "feature") \
        .withColumn("x", (F.col("x") - F.col("mean")) / F.col("std")).drop("mean", "std")


@dataclass
class GaussianModel:
    classes: list[str]
    prior: DataFrame      # (label, n_docs, log_prior)
    stats: DataFrame      # (label, feature, mean, var)
    scaler: DataFrame | None


def gaussian_fit(train: DataFrame | FeatureRows, train_docs: DataFrame, var_smoothing: float = 1e-9,
                 normalize: bool = True) -> GaussianModel:
    """Per class mean and population variance + var_smoothing·max feature variance.

    ``train``: (doc_id, label, feature, x), or one column a feature, of which no row a feature is made.
    """
    classes = class_list(train_docs)
    scaler = scaler_fit(train) if normalize else None
    if isinstance(train, FeatureRows) and normalize:
        scaler = scaler.checkpoint()  # one row a feature, read by the scaling and by every scoring
    lt = scale(train, scaler) if normalize else train
    if isinstance(lt, FeatureRows):
        spread = lt.wide.agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in lt.features]).first() if lt.features else ()
        eps = max((v for v in spread if v is not None), default=0.0) * var_smoothing
        if lt.features:
            stats = _moments(lt, "label").select("label", "feature", "mean", F.col("var").alias("v0")).checkpoint()
        else:  # no rows
            stats = train.wide.select("label", F.lit("").alias("feature"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("v0")).limit(0)
    else:
        eps = lt.groupBy("feature").agg(F.var_pop("x").alias("v")).agg(F.max("v").alias("m")).first()["m"]
        eps = float(eps or 0.0) * var_smoothing  # one scalar
        stats = lt.groupBy("label", "feature").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("v0"))
    stats = stats.select("label", "feature", "mean", (F.col("v0") + F.lit(eps)).alias("var"))
    counts = train_docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    prior = counts.select("label", "n_docs", F.log(F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy()))
                          .alias("log_prior"))
    return GaussianModel(classes, prior, stats, scaler)


def gaussian_score(model: GaussianModel, long_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """Log prior - ½Σ ln(2πσ²) - ½Σ (x-μ)²/σ², softmax, argmax."""
    features = [r[0] for r in model.stats.select("feature").distinct().orderBy("feature").collect()]
    wide = docs.select("doc_id").join(
        long_docs.groupBy("doc_id").pivot("feature", features).agg(F.first("x")), "doc_id", "left")
    return gaussian_score_wide(model, wide)


def gaussian_score_wide(model: GaussianModel, wide: DataFrame) -> DataFrame:
    """L9 over one column per feature: array products on batches of rows with the model's classes x
    features numbers, so nothing is joined, exploded or shuffled.  A missing value adds nothing."""
    stats = {(r.label, r.feature): (r["mean"], r["var"]) for r in model.stats.collect()}
    scaler = {r.feature: (r["mean"], r["std"]) for r in model.scaler.collect()} if model.scaler is not None else {}
    prior = {r.label: r.log_prior for r in model.prior.collect()}
    features = sorted({f for _, f in stats})
    at, width = (np.array([scaler.get(f, (0.0, 1.0))[i] for f in features], dtype=np.float64) for i in (0, 1))
    per_class = []
    for c in model.classes:
        # a feature the class has no statistics of adds nothing
        mean = [stats.get((c, f), (0.0, math.inf))[0] for f in features]
        half = [0.5 / stats.get((c, f), (0.0, math.inf))[1] for f in features]
        const = prior[c] - 0.5 * sum(math.log(2 * math.pi * stats[c, f][1]) for f in features if (c, f) in stats)
        per_class.append((np.array(mean, dtype=np.float64), np.array(half, dtype=np.float64), const))
    names = [f"_s{i}" for i in range(len(model.classes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, len(features)))
            for i in range(len(features)):
                x[:, i] = b.column(i + 1).to_numpy(zero_copy_only=False)
            x = (x - at) / width
            gone = np.isnan(x)
            if not gone.any():
                gone = None
            scores = []
            for mean, half, const in per_class:
                d = x - mean
                d *= d
                if gone is not None:
                    d[gone] = 0.0
                scores.append(pa.array(const - d @ half, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *scores], ["doc_id", *names])

    key = wide.schema["doc_id"].dataType.simpleString()
    scored = wide.select("doc_id", *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]) \
        .mapInArrow(run, f"doc_id {key}, {', '.join(f'{n} DOUBLE' for n in names)}")
    return softmax_columns(scored, model.classes, names, ["doc_id"])


def feature_importance(model: GaussianModel) -> DataFrame:
    """Σ_{i<j} |μi-μj| / (sqrt((vi+vj)/2) + 1e-10), normalised to sum 1; uniform if 0."""
    a = model.stats.alias("a")
    b = model.stats.alias("b")
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.label") < F.col("b.label")))
    imp = pairs.select(F.col("a.feature").alias("feature"),
                       (F.abs(F.col("a.mean") - F.col("b.mean"))
                        / (F.sqrt((F.col("a.var") + F.col("b.var")) / 2.0) + 1e-10)).alias("v")) \
        .groupBy("feature").agg(F.sum("v").alias("v"))
    feats = model.stats.select("feature").distinct()
    imp = feats.join(imp, "feature", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy()
    tot, n = F.sum("v").over(w), F.count(F.lit(1)).over(w)
    return imp.select("feature", F.when(tot > 0, F.col("v") / tot).otherwise(1.0 / n).alias("importance"))


def anova_f(train: DataFrame | FeatureRows) -> DataFrame:
    """ANOVA F per feature: (SSB/(k-1)) / (SSW/(n-k)); null when SSW ~ 0."""
    if isinstance(train, FeatureRows):
        g = _moments(train, "label").select("feature", "label", F.col("n").alias("n_c"), F.col("mean").alias("m"), F.col("var").alias("v"))
    else:
        g = train.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n_c"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")  # small: features x classes rows
    g = (g.withColumn("n_all", F.sum("n_c").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
         .withColumn("gm", F.sum(F.col("n_c") * F.col("m")).over(w) / F.col("n_all")))
    f = g.groupBy("feature").agg(
        F.sum(F.col("n_c") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
        F.sum(F.col("n_c") * F.col("v")).alias("ssw"),
        F.first("n_all").alias("n_all"), F.first("k").alias("k"))
    return f.select("feature", F.when(F.col("ssw") > 1e-9, (F.col("ssb") / (F.col("k") - 1))
                                      / (F.col("ssw") / (F.col("n_all") - F.col("k")))).alias("f_score"))


def f_rank(score: str = "f_score") -> list[Column]:
    """L11 order: F to nine significant digits, then name.  The last digits of a sum depend
    on the order of its terms, so equal features would else swap places between runs."""
    f = F.when(F.col(score) > 0, F.col(score))
    e = F.floor(F.log10(f))
    return [e.desc_nulls_last(), F.round(f / F.pow(F.lit(10.0), e), 8).desc_nulls_last(), F.col("feature")]


def select_k_best(scores: DataFrame, k: int = 20) -> DataFrame:
    """Top k features by F (ties by name); bounded by k."""
    return scores.orderBy(*f_rank()).limit(k)


# ---------------------------------------------------------------- L19-L21

def readable_label(col: Column, mapping: dict[str, str]) -> Column:
    """Class code -> readable label, falling back to the code."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, col), col)


def relevant_terms(pred: DataFrame, doc_terms_present: DataFrame, weights: DataFrame, top_n: int = 5) -> DataFrame:
    """Top-n vocabulary terms present in the document by the predicted class's weight.

    ``weights``: (label, term, w) model table (bounded, broadcast).
    """
    j = (doc_terms_present.select("doc_id", "term").distinct()
         .join(pred.select("doc_id", F.col("predicted_class").alias("label")), "doc_id")
         .join(F.broadcast(weights.select("label", "term", "w")), ["label", "term"]))
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("w").desc(), F.col("term")))
    top = j.withColumn("rn", rn).filter(F.col("rn") <= top_n)
    return top.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda s: s["term"]).alias("relevant_terms"))
