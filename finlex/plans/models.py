"""The three model pipelines (type, sentiment, impact) built from the operators.

Each returns the intermediate tables a caller may want (vocabulary, model
tables, predictions) so queries, explanations and the aggregator share one
definition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FE
from ..functions import terms as T
from ..functions import text as TX
from ..operators import evaluate as EV
from ..operators import naive_bayes as NB
from ..operators import selection as SE
from ..operators import vocab as VO
from ..sources import fixtures as FX
from ..session import materialize
from ..sources import tables as S

SEED = 42
VALIDATION = 0.2

# features of the impact model (numeric F14-F22 columns)
IMPACT_FEATURES = [
    "percentage_count", "max_percentage", "min_percentage", "avg_percentage", "sum_percentage",
    "high_percentage_count", "medium_percentage_count", "low_percentage_count", "currency_count",
    "numeric_value_count", "numerical_density", "high_impact_count", "high_impact_density",
    "medium_impact_count", "medium_impact_density", "low_impact_count", "low_impact_density",
    "high_to_low_ratio", "high_to_medium_ratio", "short_term_count", "medium_term_count",
    "long_term_count", "timeframe_numeric", "composite_impact_score", "volatility_index",
]


@dataclass
class TypePipeline:
    docs: DataFrame        # (doc_id, label)
    train_docs: DataFrame
    terms: DataFrame       # (doc_id, label, term, idx, n) of the vocabulary's terms
    vocab: DataFrame
    model: NB.BernoulliModel
    pred: DataFrame
    vectors: VO.TermVectors
    texts: DataFrame       # (doc_id, label, tt), written


def type_vocabulary(spark, sf):
    """X1 alone: the type model's vocabulary from the training split."""
    d = S.table(spark, sf, "documents", "doc_id", "text")
    docs = d.select("doc_id", TX.normalize_variant("text", "type").alias("tt"))
    train, _ = EV.train_validation_split(docs, VALIDATION, SEED)
    return VO.fit_vocabulary(materialize(train.select("tt"), "normalised"), "tt", VO.TYPE_VOCAB)


def type_pipeline(spark, sf, labelled: DataFrame | None = None) -> TypePipeline:
    """Bernoulli NB over binary word 1-2-grams of ``labelled`` (doc_id, text, label);
    without it of ``documents``, label = language."""
    d = labelled if labelled is not None else S.table(spark, sf, "documents", "doc_id", "text", "lang").select(
        "doc_id", "text", F.col("lang").alias("label"))
    docs = d.select("doc_id", "label", TX.normalize_variant("text", "type").alias("tt"))
    texts = materialize(docs, "normalised")
    vec, vocab = normalised_terms(texts, "tt", VO.TYPE_VOCAB)
    terms, labels = vec.long(), vec.given.select("doc_id", "label")
    train_docs, _ = EV.train_validation_split(labels, VALIDATION, SEED)
    present = vec.present()
    train_terms, _ = EV.train_validation_split(present, VALIDATION, SEED)
    model = NB.bernoulli_fit(train_terms, train_docs, vocab)
    pred = NB.bernoulli_score(model, present, labels.select("doc_id"))
    return TypePipeline(labels, train_docs, terms, vocab, model, pred, vec, texts)


def normalised_terms(docs: DataFrame, norm_col: str, cfg: VO.VocabConfig, keep: tuple[str, ...] = ("label",)) -> tuple[VO.TermVectors, DataFrame]:
    """The documents' vectors of the vocabulary's terms, and the vocabulary of the training split.

    ``docs`` are normalised once and written; the passes over them read that: words and n-grams are
    counted (summed in the task), then the vocabulary's are kept, one row a document, written too.
    """
    train, _ = EV.train_validation_split(docs, VALIDATION, SEED)
    vocab = VO.fit_vocabulary(train, norm_col, cfg).checkpoint()
    return VO.vectorize(docs, norm_col, vocab, cfg, keep), vocab


@dataclass
class SentimentPipeline:
    docs: DataFrame
    vocab: DataFrame
    idf: DataFrame
    weights: DataFrame     # (doc_id, term, idx, w) TF-IDF of all documents
    model: NB.ComplementModel
    pred: DataFrame
    vectors: VO.TermVectors
    labelled: VO.TermRows | DataFrame  # the weights beside the label of each row of their document
    weighted: VO.TermRows | DataFrame  # the weights, a row a document where each has one row
    texts: DataFrame       # (doc_id, label, st), written


def sentiment_pipeline(spark, sf, weighting: str = "standard") -> SentimentPipeline:
    """Complement NB over TF-IDF word 1-3-grams of ``ann``, label = sentiment."""
    a = FX.ann_texts(spark, sf)
    docs = a.select("doc_id", F.col("sentiment_label").alias("label"),
                    TX.normalize_variant("text", "sentiment").alias("st"))
    texts = materialize(docs, "normalised")
    vec, vocab = normalised_terms(texts, "st", VO.SENTIMENT_VOCAB)
    labels = vec.given.select("doc_id", "label")
    train_docs, _ = EV.train_validation_split(labels, VALIDATION, SEED)
    train_vec, _ = EV.train_validation_split(vec, VALIDATION, SEED)
    idf = VO.idf_table(train_vec, train_docs.agg(F.count(F.lit(1))).first()[0], vocab).checkpoint()
    all_w = VO.tfidf_rows(vec, idf)
    train_w, _ = EV.train_validation_split(all_w, VALIDATION, SEED)
    model = NB.complement_fit(train_w, train_docs, vocab, weighting=weighting)
    pred = NB.complement_score(model, all_w, labels.select("doc_id"))
    weights = VO.tfidf(vec, idf).drop("label")
    labelled = weights.join(labels, "doc_id") if vec.repeated else all_w
    return SentimentPipeline(labels, vocab, idf, weights, model, pred, vec, labelled, weights if vec.repeated else all_w, texts)


@dataclass
class ImpactPipeline:
    docs: DataFrame
    long: DataFrame        # (doc_id, label, feature, x)
    model: NB.GaussianModel
    pred: DataFrame
    wide: DataFrame        # (doc_id, label, one column a feature), written


def impact_features_wide(spark, sf) -> DataFrame:
    a = FX.ann_texts(spark, sf)
    b = a.select("doc_id", F.col("impact_label").alias("label"), TX.normalize_variant("text", "impact").alias("it"))
    f = FE.with_impact_features(b, "it", keep=("doc_id", "label"))
    return f.select("doc_id", "label", *[F.col(k).cast("double").alias(k) for k in IMPACT_FEATURES])


def impact_pipeline(spark, sf, var_smoothing: float = 1e-9, wide: DataFrame | None = None) -> ImpactPipeline:
    """Gaussian NB over standardised numeric impact features of ``ann``; ``wide``: these features, written."""
    if wide is None:
        wide = materialize(impact_features_wide(spark, sf), "impact")  # read by scaler, fit, priors and scoring
    rows = NB.FeatureRows(wide, IMPACT_FEATURES)
    train_docs, _ = EV.train_validation_split(wide.select("doc_id", "label"), VALIDATION, SEED)
    train_rows, _ = EV.train_validation_split(rows, VALIDATION, SEED)
    model = NB.gaussian_fit(train_rows, train_docs, var_smoothing)
    pred = NB.gaussian_score_wide(model, wide)
    return ImpactPipeline(wide.select("doc_id", "label"), rows.long(), model, pred, wide)


def selected_impact_pipeline(spark, sf) -> tuple[ImpactPipeline, dict]:
    """L15 wired into the model: grid search, then a fit on the best smoothing and its k best features."""
    wide = materialize(impact_features_wide(spark, sf), "impact")
    point = SE.best_point(SE.gaussian_grid(wide, IMPACT_FEATURES), "var_smoothing", "k")
    train, _ = EV.train_validation_split(wide, VALIDATION, SEED)
    rows = NB.FeatureRows(train, IMPACT_FEATURES)
    scaled = NB.scale(rows, NB.scaler_fit(rows))
    best = [r.feature for r in NB.select_k_best(NB.anova_f(scaled), point["k"]).collect()]  # at most k names
    model = NB.gaussian_fit(NB.FeatureRows(train, best), train.select("doc_id", "label"), point["var_smoothing"])
    pred = NB.gaussian_score_wide(model, wide)
    return ImpactPipeline(wide.select("doc_id", "label"), NB.unpivot_features(wide, best, keep=("doc_id", "label")), model, pred, wide), point


# ---------------------------------------------------------------- X6 models over text and numeric features

# numeric features beside the text terms
TYPE_NUMERIC = [f"count_{name}" for name in T.TYPE_INDICATORS]
SENTIMENT_NUMERIC = [f"{c}_terms_{k}" for c in T.DEFAULT_LEXICON for k in ("count", "density")] + [
    "negation_count", "intensifier_count", "diminisher_count"]


def _union_input(spark, sf, kind: str, cfg: VO.VocabConfig, label: str):
    """Labels, the vocabulary's term vectors and the text features of ``ann``.

    The features are columns of the documents' own rows; only where a doc_id has several rows are
    the vectors a table of their own.
    """
    a = FX.ann_texts(spark, sf).select("doc_id", F.col(label).alias("label"), "text")
    b = a.select("doc_id", "label", TX.normalize_variant("text", "type").alias("tt"),
                 TX.normalize_variant("text", "sentiment").alias("st"))
    norm = {"type": "tt", "sentiment": "st"}[kind]
    names = {"type": TYPE_NUMERIC, "sentiment": SENTIMENT_NUMERIC}[kind]
    keep = ("doc_id", "label", "tt", "st")
    wide = FE.with_scanned_text_features(b, "tt", "st", keep=keep)
    wide = materialize(wide.select("doc_id", "label", F.col(norm).alias("_norm"), *names), "features")
    vec, vocab = normalised_terms(wide, "_norm", cfg, ("label", *names))
    if vec.repeated:
        vec = VO.vectorize(wide, "_norm", vocab, cfg, ("label",))
    else:
        vec = replace(vec, keep=("label",))
    return vec.given.select("doc_id", "label"), vec, vocab, wide.select("doc_id", "label", *names)


def type_union_model(spark, sf) -> tuple[NB.BernoulliModel, DataFrame | VO.TermRows, DataFrame]:
    """Bernoulli NB over binary terms and numeric features (present above zero): (model, rows of all documents, docs)."""
    docs, vec, vocab, wide = _union_input(spark, sf, "type", VO.TYPE_VOCAB, "type_label")
    if vec.repeated:
        rows = VO.union_rows(vec.long().withColumn("w", F.lit(1.0)), wide, TYPE_NUMERIC, ("label",)).filter("w > 0")
    else:
        rows = VO.union_rows(vec.present(), wide, TYPE_NUMERIC, ("label",))  # a weight is one above zero
    train_docs, _ = EV.train_validation_split(docs, VALIDATION, SEED)
    train_rows, _ = EV.train_validation_split(rows, VALIDATION, SEED)
    return NB.bernoulli_fit(train_rows, train_docs, VO.union_vocabulary(vocab, TYPE_NUMERIC)), rows, docs


def sentiment_union_model(spark, sf) -> tuple[NB.ComplementModel, DataFrame | VO.TermRows, DataFrame]:
    """Complement NB over TF-IDF terms and numeric features: (model, rows of all documents, docs)."""
    docs, vec, vocab, wide = _union_input(spark, sf, "sentiment", VO.SENTIMENT_VOCAB, "sentiment_label")
    train_docs, _ = EV.train_validation_split(docs, VALIDATION, SEED)
    train_terms, _ = EV.train_validation_split(vec, VALIDATION, SEED)
    idf = VO.idf_table(train_terms, train_docs.agg(F.count(F.lit(1))).first()[0], vocab).checkpoint()
    rows = VO.union_rows(VO.tfidf_rows(vec, idf), wide, SENTIMENT_NUMERIC, ("label",))
    train_rows, _ = EV.train_validation_split(rows, VALIDATION, SEED)
    return NB.complement_fit(train_rows, train_docs, VO.union_vocabulary(vocab, SENTIMENT_NUMERIC)), rows, docs


# ---------------------------------------------------------------- scoring with loaded models

def score_type(spark, sf, loaded, texts: DataFrame | None = None) -> DataFrame:
    """``texts``: (doc_id, tt) if they are written already; likewise below."""
    if texts is None:
        texts = S.table(spark, sf, "documents", "doc_id", "text").select("doc_id", TX.normalize_variant("text", "type").alias("tt"))
    rows = VO.vectorize(texts, "tt", loaded.type_vocab, VO.TYPE_VOCAB).present()
    return NB.bernoulli_score(loaded.type_model, rows, texts.select("doc_id"))


def score_sentiment(spark, sf, loaded, texts: DataFrame | None = None) -> DataFrame:
    if texts is None:
        texts = FX.ann_texts(spark, sf).select("doc_id", TX.normalize_variant("text", "sentiment").alias("st"))
    vec = VO.vectorize(texts, "st", loaded.sentiment_vocab, VO.SENTIMENT_VOCAB)
    return NB.complement_score(loaded.sentiment_model, VO.tfidf_rows(vec, loaded.idf), texts.select("doc_id"))


def score_impact(spark, sf, loaded, wide: DataFrame | None = None) -> DataFrame:
    return NB.gaussian_score_wide(loaded.impact_model, impact_features_wide(spark, sf) if wide is None else wide)
