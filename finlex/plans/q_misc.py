"""Queries for lexicon I/O, persistence, run quality, pipeline composition and
tuning (S3-S8, V10, V11, V13, T3, T10-T17, Q1, Q2, L12, L15, L16, L18, L22, L23)."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FE
from ..functions import terms as T
from ..functions import text as TX
from ..functions import validate as V
from ..operators import evaluate as EV
from ..operators import naive_bayes as NB
from ..operators import quality as QY
from ..operators import tuning as TU
from ..operators import vocab as VO
from ..sources import fixtures as FX
from ..sources import lexicon as LX
from ..sources import model_store as MS
from ..session import materialize
from ..sources import tables as S
from ..streaming.stream import work_dir
from . import models as M
from . import pipeline as PL
from .q_features import LEXICON_TEST
from .q_models import BUCKET, IMPACT_MODEL_CTE, SENT_CTE, TYPE_CTE
from .registry import (q, register, sql_contains_any, sql_count_terms, sql_distinct_present,
                       sql_norm_variant)

R = 6
LANG_CATEGORY = {"en": "positive", "fr": "negative", "de": "neutral"}


MIN_CORPUS_COUNT = 20


def corpus_terms(spark, sf):
    """(category, term): every word of 4+ characters that a language has ``MIN_CORPUS_COUNT`` times."""
    d = S.table(spark, sf, "documents", "doc_id", "text", "lang")
    w = d.select("lang", F.explode_outer(F.filter(TX.words(TX.normalize_variant("text", "sentiment")),
                                                  lambda x: F.length(x) >= 4)).alias("term")) \
        .filter(F.col("term").isNotNull())
    c = w.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_CORPUS_COUNT)
    cat = F.coalesce(F.create_map(*[x for kv in LANG_CATEGORY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[
        F.col("lang")], F.lit("mixed"))
    return c.select(cat.alias("category"), "term").distinct()


CORPUS_SQL = f"""
WITH w AS (SELECT lang, unnest(list_filter(string_split({sql_norm_variant('text', 'sentiment')}, ' '),
  lambda x: length(x) >= 4)) AS term FROM documents),
c AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= {MIN_CORPUS_COUNT}),
ct AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'positive' WHEN 'fr' THEN 'negative' WHEN 'de' THEN 'neutral' ELSE 'mixed' END
  AS category, term FROM c),
dl AS (SELECT * FROM (VALUES {", ".join(f"('default', {q(c)}, {q(t)}, {i})" for c in LX.CATEGORIES
                                         for i, t in enumerate(T.DEFAULT_LEXICON[c]))}) t(name, category, term, ord))
"""


@register("S5_resolve_lexicon", CORPUS_SQL + """
SELECT 'corpus' AS name, category, term FROM ct WHERE category IN ('positive', 'negative', 'neutral')""")
def s5_resolve(spark, sf):
    corpus = corpus_terms(spark, sf).filter(F.col("category").isin(*LX.CATEGORIES)) \
        .select(F.lit("corpus").alias("name"), "category", "term", F.lit(0).alias("ord"), F.lit(1).alias("load_order"))
    lexicons = corpus.unionByName(LX.default_lexicon(spark).withColumn("load_order", F.lit(2)))
    return LX.resolve_lexicon(lexicons, None, LX.default_lexicon(spark)).select("name", "category", "term")


_EXTENDED_SQL = CORPUS_SQL + """
, mx AS (SELECT category, max(ord) AS m FROM dl GROUP BY category),
ext AS (SELECT 'default' AS name, ct.category, ct.term,
  CAST(mx.m + row_number() OVER (PARTITION BY ct.category ORDER BY ct.term) AS INTEGER) AS ord
  FROM ct JOIN mx USING (category)
  WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.category = ct.category AND dl.term = ct.term)),
lex AS (SELECT * FROM dl UNION ALL SELECT * FROM ext)
"""


@register("S6_extend_lexicon", _EXTENDED_SQL + "SELECT * FROM lex")
def s6_extend(spark, sf):
    return LX.extend_lexicon(LX.default_lexicon(spark), corpus_terms(spark, sf))


@register("S3_S4_lexicon_roundtrip", _EXTENDED_SQL + """
SELECT n.name, category, term, ord FROM lex CROSS JOIN (VALUES ('from_json'), ('from_csv'), ('from_parquet')) n(name)""")
def s3_s4_roundtrip(spark, sf):
    """Save the corpus-extended lexicon in each one-row-a-term format, load all back."""
    lex = LX.extend_lexicon(LX.default_lexicon(spark), corpus_terms(spark, sf))
    base = work_dir(spark, "lexicon")
    loaded = []
    for name, fmt in (("from_json", "jsonl"), ("from_csv", "csv"), ("from_parquet", "parquet")):
        LX.save_lexicon(lex, f"{base}/{fmt}", fmt)
        loaded.append(LX.load_lexicon(spark, f"{base}/{fmt}", name))
    return reduce(DataFrame.unionByName, loaded)


_PRED = "SELECT '{m}' AS model, doc_id, predicted_class, round(confidence, 6) AS confidence FROM ({cte} SELECT * FROM pred)"


@register("S7_model_persistence", "\nUNION ALL ".join([
    _PRED.format(m="bernoulli", cte=TYPE_CTE), _PRED.format(m="complement", cte=SENT_CTE), _PRED.format(m="gaussian", cte=IMPACT_MODEL_CTE)]))
def s7_persistence(spark, sf):
    """Save all three models with their vocabularies, idf and scaler; load them and score with the loaded ones."""
    path = work_dir(spark, "model")
    fitted = M.type_pipeline(spark, sf), M.sentiment_pipeline(spark, sf), M.impact_pipeline(spark, sf)
    MS.save_models(spark, path, *fitted)
    loaded = MS.load_models(spark, path)
    if loaded.warnings:
        raise ValueError(loaded.warnings)
    # the normalised texts and features are written, so they are not made again
    preds = {"bernoulli": M.score_type(spark, sf, loaded, fitted[0].texts), "complement": M.score_sentiment(spark, sf, loaded, fitted[1].texts),
             "gaussian": M.score_impact(spark, sf, loaded, fitted[2].wide)}
    return reduce(DataFrame.unionByName, [p.select(F.lit(m).alias("model"), "doc_id", "predicted_class", F.round("confidence", 6)
                                                   .alias("confidence")) for m, p in preds.items()])


_SENT_SQL = ("list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'),"
             " chr(1)), lambda s: s <> '')")


def _processed_documents(spark, sf):
    d = S.documents(spark, sf, with_metadata=True)
    v = V.validate_documents(d).withColumn("text", F.coalesce("clean_text", F.lit("")))
    out = PL.default_pipeline().process(v)
    return PL.with_step_errors(out, {"tokenizer": F.size("sentences") > 1})


@register("S8_batch_result_sink", f"""
SELECT doc_id, length(text) < 1 AS has_error,
  len(CASE WHEN length(text) < 1 THEN [] ELSE {_SENT_SQL} END) <= 1 AS has_warnings,
  CAST(5 AS BIGINT) AS num_features, source AS md_source FROM documents""")
def s8_sink(spark, sf):
    out = _processed_documents(spark, sf)
    res = MS.batch_results(out, ["is_relatorio", "is_comunicado", "is_guidance", "positive_count", "negative_count"])
    return res.select("doc_id", "has_error", "has_warnings", "num_features",
                      F.col("metadata")["source"].alias("md_source"))


ORDER_CONTRACT = {
    "o_orderkey": {"type": "bigint", "required": True},
    "o_totalprice": {"type": "double", "required": True},
    "o_orderstatus": {"allowed": ["F", "O", "P"]},
    "o_orderpriority": {"allowed": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
}


@register("V10_contract_report", """
SELECT 'o_orderkey' AS "column", 'type' AS "check", CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'o_orderkey', 'required', CAST(count_if(o_orderkey IS NULL) AS BIGINT) FROM orders
UNION ALL SELECT 'o_totalprice', 'type', CAST(0 AS BIGINT)
UNION ALL SELECT 'o_totalprice', 'required', CAST(count_if(o_totalprice IS NULL) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderstatus', 'allowed', CAST(count_if(NOT o_orderstatus IN ('F', 'O', 'P')) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderpriority', 'allowed', CAST(count_if(NOT o_orderpriority IN
  ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS BIGINT) FROM orders""")
def v10_contract(spark, sf):
    o = S.table(spark, sf, "orders")
    return QY.contract_report(o, ORDER_CONTRACT)


NESTED_CONTRACT = {
    "payload": {"required": True, "properties": {
        "type": {"type": "string", "required": True, "allowed": ["click", "view", "signup", "purchase"]},
        "value": {"type": "double", "required": True}, "unit": {"required": True}}},
    "props": {"properties": {"k": {"type": "int", "required": True}, "source": {"required": True}}},
    "tags": {"items": {"type": "string", "required": True, "allowed": ["seen", "click", "view", "signup", "purchase", "error"]}},
}


@register("V10_nested_contract", """
WITH e AS (SELECT event_id % 7 <> 0 AS has_payload, event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS v,
  CASE WHEN event_id % 13 = 0 THEN 'x' ELSE '' END || json_extract_string(props, '$.k') AS k, event_id % 5 = 0 AS no_tag FROM events),
c(path, "check", violations) AS (
  SELECT 'payload', 'required', count_if(NOT has_payload) FROM e
  UNION ALL SELECT 'payload.type', 'type', 0
  UNION ALL SELECT 'payload.type', 'required', count_if(has_payload AND event_type IS NULL) FROM e
  UNION ALL SELECT 'payload.type', 'allowed', count_if(has_payload AND event_type NOT IN ('click', 'view', 'signup', 'purchase')) FROM e
  UNION ALL SELECT 'payload.value', 'type', 0
  UNION ALL SELECT 'payload.value', 'required', count_if(has_payload AND v IS NULL) FROM e
  UNION ALL SELECT 'payload.unit', 'present', 1
  UNION ALL SELECT 'props.k', 'type', count_if(TRY_CAST(k AS INTEGER) IS NULL) FROM e
  UNION ALL SELECT 'props.k', 'required', count_if(k IS NULL) FROM e
  UNION ALL SELECT 'props.source', 'required', count(*) FROM e
  UNION ALL SELECT 'tags[]', 'type', 0
  UNION ALL SELECT 'tags[]', 'required', count_if(no_tag) FROM e
  UNION ALL SELECT 'tags[]', 'allowed', count_if(event_type NOT IN ('click', 'view', 'signup', 'purchase', 'error')) FROM e)
SELECT path, "check", CAST(violations AS BIGINT) AS violations FROM c""")
def v10_nested(spark, sf):
    """Contract of nested events: a struct that may be missing, a map of properties, and an array of tags."""
    e = S.table(spark, sf, "events", "event_id", "event_type", "value", "props")
    k = F.col("event_id")
    nested = e.select(
        F.when(k % 7 != 0, F.struct(F.col("event_type").alias("type"), F.when(k % 11 != 0, F.col("value")).alias("value"))).alias("payload"),
        F.transform_values(F.from_json("props", "map<string,string>"), lambda _, v: F.concat(F.when(k % 13 == 0, "x").otherwise(""), v)).alias("props"),
        F.array("event_type", F.when(k % 5 != 0, "seen")).alias("tags"))
    return QY.nested_contract_report(nested, NESTED_CONTRACT)


@register("V11_error_taxonomy", """
SELECT 'TEXT_TOO_SHORT' AS error_code, 'warning' AS severity, 'validator' AS component,
  CAST(count(*) AS BIGINT) AS n FROM documents WHERE length(text) < 300
UNION ALL SELECT 'MISSING_METADATA_FIELD', 'error', 'validator', CAST(count(*) AS BIGINT) FROM events
  WHERE event_type <> 'click'""")
def v11_taxonomy(spark, sf):
    d = V.validate_documents(S.table(spark, sf, "documents", "doc_id", "text"), min_length=300)
    e = S.table(spark, sf, "events", "event_id", "event_type", "props")
    md, _ = V.parse_metadata("props")
    md2 = F.when(F.col("event_type") == "click", F.map_concat(md, F.create_map(F.lit("click"), F.lit("1")))) \
        .otherwise(md)
    errs = d.select("error_code").unionByName(e.select(V.require_fields(md2, ["click"]).alias("error_code")))
    return QY.error_counts(errs)


@register("V13_conditional_gate", """
SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN error('negative order price') ELSE o_totalprice END AS o_totalprice
FROM orders""")
def v13_gate(spark, sf):
    """Orders pass the gate: no negative prices."""
    o = S.table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return QY.gate(o, F.col("o_totalprice") < 0, "negative order price")


@register("T3_stopwords")
def t3_stopwords(spark, sf):
    a = FX.ann_texts(spark, sf).select("doc_id", TX.words(TX.normalize_variant("text", "sentiment")).alias("w"))
    return a.select("doc_id", F.size("w").alias("words"), F.size(PL.remove_stopwords("w")).alias("content_words"))


@register("T10_T13_pipeline", f"""
SELECT doc_id, {sql_contains_any(sql_norm_variant('text', 'type'), T.COARSE_TYPE_INDICATORS['relatorio'])} AS is_relatorio,
  {sql_distinct_present(sql_norm_variant('text', 'type'), T.COARSE_POSITIVE)} AS positive_count,
  CAST(len(list_filter(string_split({sql_norm_variant('text', 'type')}, ' '), lambda x: x <> '')) AS BIGINT) AS word_count
FROM documents""")
def t10_t13(spark, sf):
    """Default pipeline over documents; unrequested steps are not in the plan."""
    p = PL.default_pipeline()
    p.add_step("entity_extractor", lambda df: df, enabled=False)
    out = p.process(S.table(spark, sf, "documents", "doc_id", "text"))
    return out.select("doc_id", "is_relatorio", "positive_count", "derived_metadata.word_count")


@register("T12_observed_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count_if(length(text) < 1) AS BIGINT) AS errors,
  CAST(count_if(length(text) >= 1 AND len({_SENT_SQL}) <= 1) AS BIGINT) AS with_warnings FROM documents""")
def t12_stats(spark, sf):
    out = _processed_documents(spark, sf).withColumn(
        "warnings", F.when(F.col("error_code").isNull(), F.col("warnings")).otherwise(F.array().cast("array<string>")))
    o, obs = PL.observed_stats(out)
    o.write.format("noop").mode("overwrite").save()
    m = obs.get
    return spark.createDataFrame([(int(m["processed"]), int(m["errors"]), int(m["with_warnings"]))],
                                 "processed BIGINT, errors BIGINT, with_warnings BIGINT")


@register("T14_compute_once", "SELECT doc_id, " + ", ".join(
    f"{sql_count_terms(sql_norm_variant('text', 'sentiment'), LEXICON_TEST[c])} AS {c}_terms_count"
    for c in LEXICON_TEST) + " FROM documents")
def t14_once(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")

    def heavy(u):
        st = TX.normalize_variant("text", "sentiment")
        f = FE.lexicon_features(st, LEXICON_TEST)
        return u.select("_key", *[f[f"{c}_terms_count"].alias(f"{c}_terms_count") for c in LEXICON_TEST])
    return PL.compute_once(d, heavy, config_key="sentiment|lexicon_test")


@register("T15_reuse_stats", """
WITH k AS (SELECT md5(text) AS k, length(text) AS n FROM documents),
p AS (SELECT k, count(*) AS c, any_value(n) AS n FROM k GROUP BY k)
SELECT CAST(sum(c) AS BIGINT) AS requests, CAST(count(*) AS BIGINT) AS misses, CAST(sum(c) - count(*) AS BIGINT) AS hits,
  CAST(sum((c - 1) * n) AS BIGINT) AS chars_saved, round((sum(c) - count(*)) / sum(c), 6) AS hit_rate FROM p""")
def t15_reuse(spark, sf):
    r = PL.reuse_stats(S.table(spark, sf, "documents", "doc_id", "text"))
    return r.select(*[F.col(c).cast("bigint").alias(c) for c in ("requests", "misses", "hits", "chars_saved")],
                    F.round("hit_rate", R).alias("hit_rate"))


@register("T16_T17_batches_and_callback", """
SELECT (row_number() OVER () - 1) // 100 AS batch_id, count(*) OVER () AS callbacks FROM documents
""".join(["SELECT batch_id, CAST(count(*) AS BIGINT) AS docs, CAST(any_value(callbacks) AS BIGINT) AS callbacks FROM (",
          ") GROUP BY batch_id"]))
def t16_t17(spark, sf):
    """Batches of 100 in input order; a per-partition callback counts results."""
    d = S.table(spark, sf, "documents", "doc_id", "text")
    b = PL.batched(d.select("doc_id", F.length("text").alias("n")), 100)
    acc = spark.sparkContext.accumulator(0)
    PL.for_each_result(b, lambda r: acc.add(1))
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("docs"), F.lit(acc.value).cast("bigint").alias("callbacks"))


@register("Q1_throughput_report")
def q1_throughput(spark, sf):
    t0 = time.time()
    out = _processed_documents(spark, sf).select("doc_id", "error_code").checkpoint()
    return QY.throughput_report(out, time.time() - t0)


@register("Q2_edge_case_report", f"""
WITH x AS (SELECT 'document' AS kind, text AS t FROM documents UNION ALL SELECT 'page', html FROM pages)
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count_if(t IS NOT NULL AND length(t) >= 1) AS BIGINT) AS ok,
  CAST(count_if({sql_norm_variant('t', 'type')} = '') AS BIGINT) AS fallback,
  CAST(sum(length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) AS BIGINT)
    AS control_removed
FROM x GROUP BY kind""")
def q2_edge(spark, sf):
    docs = S.table(spark, sf, "documents", "text").select(F.lit("document").alias("kind"), F.col("text").alias("t"))
    pages = S.table(spark, sf, "pages", "html").select(F.lit("page").alias("kind"), F.col("html").alias("t"))
    x = docs.unionByName(pages)
    clean, err = V.validate_text("t")
    return x.select("kind", err.alias("err"), TX.normalize("t").alias("norm"),
                    (F.length("t") - F.length(TX.remove_control_chars("t"))).alias("removed")) \
        .groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("err").isNull()).alias("ok"),
                             F.count_if(F.col("norm") == "").alias("fallback"),
                             F.sum("removed").cast("bigint").alias("control_removed"))


@register("L15_fold_sizes", FX.ctes("ann") + f"""
SELECT CAST({BUCKET} % 5 AS INTEGER) AS fold, impact_label AS label, CAST(count(*) AS BIGINT) AS n
FROM (SELECT doc_id, impact_label FROM ann) GROUP BY ALL""")
def l15_folds(spark, sf):
    a = FX.ann(spark, sf).select("doc_id", F.col("impact_label").alias("label"))
    return EV.kfold(a).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


def _impact_rows(spark, sf):
    wide = materialize(M.impact_features_wide(spark, sf), "impact")
    return wide, NB.FeatureRows(wide, M.IMPACT_FEATURES)


@register("L15_grid_search")
def l15_grid(spark, sf):
    wide, rows = _impact_rows(spark, sf)
    return TU.gaussian_grid_search(rows, wide.select("doc_id", "label"))


@register("L16_sentiment_grid_search")
def l16_grid(spark, sf):
    p = M.sentiment_pipeline(spark, sf)
    w = p.labelled
    tr_w, va_w = EV.train_validation_split(w)
    tr_d, va_d = EV.train_validation_split(p.docs)
    return TU.complement_grid_search(tr_w, tr_d, va_w if isinstance(va_w, VO.TermRows) else va_w.drop("label"), va_d, p.vocab)


@register("L12_L18_calibrated_retrain")
def l12_l18(spark, sf):
    """Grid-searched var_smoothing -> refit -> threshold sweep -> sigmoid calibration;
    before / after validation metrics side by side (rows-only)."""
    wide, rows = _impact_rows(spark, sf)
    grid = TU.gaussian_grid_search(rows, wide.select("doc_id", "label"))
    best = grid.orderBy(F.col("f1").desc(), "var_smoothing").first()["var_smoothing"]
    before = M.impact_pipeline(spark, sf, wide=wide)
    after = M.impact_pipeline(spark, sf, var_smoothing=best, wide=wide)
    _, va = EV.train_validation_split(before.docs)
    m0 = EV.classification_metrics(va.join(before.pred, "doc_id")).withColumn("stage", F.lit("before"))
    m1 = EV.classification_metrics(va.join(after.pred, "doc_id")).withColumn("stage", F.lit("after"))
    pl = NB.probabilities_long(after.pred).join(after.docs.withColumnRenamed("label", "true_class"), "doc_id")
    _, pl_va = EV.train_validation_split(pl)
    pl_va = materialize(pl_va, "held-out")  # read by each class's curve, the calibration and the thresholds
    cal = TU.sigmoid_calibration(pl_va)
    n_cal = cal.count()
    thr = EV.threshold_sweep(pl_va).agg(F.avg("threshold").alias("mean_threshold")).first()[0]
    return m0.unionByName(m1).withColumn("var_smoothing", F.lit(best)) \
        .withColumn("mean_threshold", F.lit(thr)).withColumn("calibrated_rows", F.lit(n_cal))


@register("L22_scoring_stats")
def l22_stats(spark, sf):
    p = M.impact_pipeline(spark, sf)
    t0 = time.time()
    o, obs = TU.timed_scoring(p.pred)
    o.write.format("noop").mode("overwrite").save()
    secs = time.time() - t0
    n = int(obs.get["predictions"])
    return spark.createDataFrame([(n, secs, secs / max(n, 1))],
                                 "predictions BIGINT, total_seconds DOUBLE, mean_seconds DOUBLE")


@register("L23_lda_topics")
def l23_lda(spark, sf):
    p = M.type_pipeline(spark, sf)
    model, _ = TU.lda_topics(VO.sparse_vectors(p.vectors), k=20)
    return model.describeTopics(5)


@register("T11_step_error_policy", f"""
SELECT doc_id, CASE WHEN length(text) >= 1 AND len({_SENT_SQL}) <= 1 THEN 'STEP_ERROR_TOKENIZER' END AS error_code
FROM documents""")
def t11_policy(spark, sf):
    """stop_on_error: the first failed step check becomes the document's error code."""
    d = S.table(spark, sf, "documents", "doc_id", "text")
    v = V.validate_documents(d)
    ok = v.filter(F.col("error_code").isNull()).drop("error_code").withColumn("text", F.col("clean_text"))
    out = PL.with_step_errors(PL.default_pipeline().process(ok), {"tokenizer": F.size("sentences") > 1},
                              stop_on_error=True)
    bad = v.filter(F.col("error_code").isNotNull()).select("doc_id", F.lit(None).cast("string").alias("error_code"))
    return out.select("doc_id", "error_code").unionByName(bad)


@register("X6_X8_feature_union")
def x6_x8_union(spark, sf):
    """X8 registry -> X7 align by name -> X6 assemble text vector + numeric features (rows-only)."""
    VO.register_extractor("impact", lambda df: FE.with_impact_features(df, "it", keep=("doc_id",)))
    p = M.sentiment_pipeline(spark, sf)
    vec = VO.sparse_vectors(p.vectors, p.idf)
    a = FX.ann_texts(spark, sf).select("doc_id", TX.normalize_variant("text", "impact").alias("it"))
    num = VO.EXTRACTORS["impact"](a)
    aligned = VO.align_features(num, M.IMPACT_FEATURES + ["feature_missing_at_serving"])
    j = vec.join(aligned, "doc_id")
    return VO.assemble(j, "text_vector", M.IMPACT_FEATURES).select("doc_id", "features")
