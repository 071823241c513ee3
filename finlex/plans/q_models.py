"""Queries for vocabulary (X*), models (L*) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import naive_bayes as NB
from ..operators import vocab as VO
from ..sources import fixtures as FX
from . import models as M
from .q_features import BASE_SQL, IMPACT_CTE, NUM_CTE
from .registry import ORACLES, register, sql_norm_variant

R = 6
BUCKET = "((((doc_id % 1000003) * 7919 + 42) % 1000003) % 100)"


def _r(df):
    return df.select(*[F.round(F.col(f.name), R).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _terms_sql(src: str, norm: str, label: str, nmax: int, min_df: int, max_features: int) -> str:
    grams = ["w"]
    if nmax >= 2:
        grams.append("list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])")
    if nmax >= 3:
        grams.append("list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])")
    cat = grams[0]
    for g in grams[1:]:
        cat = f"list_concat({cat}, {g})"
    return f"""
d AS (SELECT doc_id, {label} AS label, {norm} AS nt FROM {src}),
tw AS (SELECT doc_id, label, list_filter(string_split(nt, ' '), lambda x: length(x) >= 2) AS w FROM d),
g AS (SELECT doc_id, label, unnest({cat}) AS term FROM tw),
dt AS (SELECT doc_id, label, term, count(*) AS n FROM g GROUP BY ALL),
trd AS (SELECT doc_id, label FROM d WHERE {BUCKET} >= 20),
tr AS (SELECT * FROM dt WHERE {BUCKET} >= 20),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx, df, tf FROM (
  SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(n) AS BIGINT) AS tf FROM tr GROUP BY term
  HAVING count(*) >= {min_df} ORDER BY tf DESC, term LIMIT {max_features})),
cls AS (SELECT label, count(*) AS n_docs FROM trd GROUP BY label)"""


_BERNOULLI_SQL = """,
fc AS (SELECT label, term, count(*) AS n_ct FROM tr JOIN vocab USING (term) GROUP BY ALL),
pri AS (SELECT label, ln(n_docs / sum(n_docs) OVER ()) AS log_prior FROM cls),
theta AS (SELECT c.label, v.term, ln((coalesce(n_ct, 0) + 1.0) / (n_docs + 2.0)) AS log_p,
  ln((n_docs - coalesce(n_ct, 0) + 1.0) / (n_docs + 2.0)) AS log_1mp, pri.log_prior AS log_prior
  FROM vocab v CROSS JOIN cls c JOIN pri ON pri.label = c.label
  LEFT JOIN fc ON fc.label = c.label AND fc.term = v.term),
base AS (SELECT label, sum(log_1mp) + any_value(log_prior) AS base FROM theta GROUP BY label),
delta AS (SELECT dt.doc_id, t.label, sum(log_p - log_1mp) AS s FROM dt JOIN theta t USING (term) GROUP BY ALL),
jll AS (SELECT x.doc_id, b.label, b.base + coalesce(delta.s, 0) AS j FROM (SELECT DISTINCT doc_id FROM d) x
  CROSS JOIN base b LEFT JOIN delta ON delta.doc_id = x.doc_id AND delta.label = b.label),
sm AS (SELECT doc_id, label, j, exp(j - max(j) OVER (PARTITION BY doc_id)) AS e FROM jll),
pr AS (SELECT doc_id, label, j, e / sum(e) OVER (PARTITION BY doc_id) AS p,
  row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, label) AS rn FROM sm),
pred AS (SELECT doc_id, label AS predicted_class, p AS confidence FROM pr WHERE rn = 1)
"""

TYPE_CTE = "WITH " + _terms_sql("documents", sql_norm_variant("text", "type"), "lang", 2, 2, 1000) + _BERNOULLI_SQL
# the same model over the announcements, label = document type
ANN_TYPE_CTE = (FX.ctes("ann") + "," + _terms_sql("ann", sql_norm_variant("text", "type"), "type_label", 2, 2, 1000)
                + _BERNOULLI_SQL)

SENT_CTE = BASE_SQL.replace("WITH ", "WITH ", 1) + "," + _terms_sql(
    "ann", sql_norm_variant("text", "sentiment"), "sentiment_label", 3, 3, 5000) + """,
ntr AS (SELECT count(*) AS n FROM trd),
trv AS (SELECT tr.* FROM tr JOIN vocab USING (term)),
idf AS (SELECT v.term, ln((1 + (SELECT n FROM ntr)) / (1 + coalesce(x.dfv, 0))) + 1 AS idf
  FROM vocab v LEFT JOIN (SELECT term, count(*) AS dfv FROM trv GROUP BY term) x USING (term)),
tfw AS (SELECT doc_id, label, term, n * idf AS w FROM dt JOIN idf USING (term)),
tf AS (SELECT doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM tfw),
fcs AS (SELECT label, term, sum(w) AS fc FROM tf WHERE doc_id IN (SELECT doc_id FROM trd) GROUP BY ALL),
grid AS (SELECT c.label, v.term, coalesce(f.fc, 0) AS fc FROM vocab v CROSS JOIN cls c
  LEFT JOIN fcs f ON f.label = c.label AND f.term = v.term),
g2 AS (SELECT label, term, sum(fc) OVER (PARTITION BY term) + 1.0 - fc AS comp FROM grid),
g3 AS (SELECT label, term, ln(comp / sum(comp) OVER (PARTITION BY label)) AS logged FROM g2),
cw AS (SELECT label, term, logged / sum(logged) OVER (PARTITION BY label) AS w FROM g3),
jll AS (SELECT x.doc_id, c.label, coalesce(s.v, 0.0) AS j FROM (SELECT DISTINCT doc_id FROM d) x CROSS JOIN cls c
  LEFT JOIN (SELECT tf.doc_id, cw.label, sum(tf.w * cw.w) AS v FROM tf JOIN cw USING (term) GROUP BY ALL) s
  ON s.doc_id = x.doc_id AND s.label = c.label),
sm AS (SELECT doc_id, label, j, exp(j - max(j) OVER (PARTITION BY doc_id)) AS e FROM jll),
pr AS (SELECT doc_id, label, j, e / sum(e) OVER (PARTITION BY doc_id) AS p,
  row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, label) AS rn FROM sm),
pred AS (SELECT doc_id, label AS predicted_class, p AS confidence FROM pr WHERE rn = 1)
"""

_IMPACT_COLS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in M.IMPACT_FEATURES)
IMPACT_MODEL_CTE = BASE_SQL + NUM_CTE + IMPACT_CTE + f"""
, fw AS (SELECT i.doc_id, a.impact_label AS label, len(pc) AS percentage_count,
  coalesce(list_max(pc), 0.0) AS max_percentage, coalesce(list_min(pc), 0.0) AS min_percentage,
  CASE WHEN len(pc) > 0 THEN list_sum(pc) / len(pc) ELSE 0.0 END AS avg_percentage,
  coalesce(list_sum(pc), 0.0) AS sum_percentage,
  len(list_filter(pc, lambda x: x >= 15)) AS high_percentage_count,
  len(list_filter(pc, lambda x: x >= 5 AND x < 15)) AS medium_percentage_count,
  len(list_filter(pc, lambda x: x < 5)) AS low_percentage_count,
  len(regexp_extract_all(p.it, '{__import__('finlex.functions.features', fromlist=['x']).CURRENCY_RE}'))
    AS currency_count,
  len(regexp_extract_all(p.it, '{__import__('finlex.functions.features', fromlist=['x']).NUMERIC_RE}'))
    AS numeric_value_count,
  high_impact_count, high_impact_density, medium_impact_count, medium_impact_density,
  low_impact_count, low_impact_density,
  CASE WHEN low_impact_count > 0 THEN high_impact_count / low_impact_count ELSE high_impact_count END
    AS high_to_low_ratio,
  CASE WHEN medium_impact_count > 0 THEN high_impact_count / medium_impact_count ELSE high_impact_count END
    AS high_to_medium_ratio,
  short_term_count, medium_term_count, long_term_count,
  CASE WHEN greatest(short_term_count, medium_term_count, long_term_count) = 0 THEN 0
       WHEN short_term_count = greatest(short_term_count, medium_term_count, long_term_count) THEN 1
       WHEN medium_term_count = greatest(short_term_count, medium_term_count, long_term_count) THEN 2 ELSE 3 END
    AS timeframe_numeric,
  CASE WHEN high_impact_count > 0 AND low_impact_count > 0
       THEN high_impact_count * low_impact_count / (high_impact_count + low_impact_count) ELSE 0.0 END
    AS volatility_index
  FROM i JOIN p ON i.doc_id = p.doc_id JOIN ann a ON a.doc_id = i.doc_id),
fw2 AS (SELECT *, len(regexp_extract_all(b.it, '\\S+')) AS nw FROM fw JOIN base b USING (doc_id)),
fw3 AS (SELECT *,
  least(1.0, (high_percentage_count * 1.5 + medium_percentage_count * 1.0 + low_percentage_count * 0.5) / 10.0) * 0.4
  + least(1.0, (high_impact_density * 1.5 + medium_impact_density * 1.0 + low_impact_density * 0.5) * 10.0) * 0.4
  + (CASE WHEN timeframe_numeric > 0 THEN (4 - timeframe_numeric) / 3.0 ELSE 0.5 END) * 0.2
    AS composite_impact_score,
  CASE WHEN nw > 0 THEN (percentage_count + currency_count + numeric_value_count) / nw ELSE 0.0 END
    AS numerical_density FROM fw2),
wide AS (SELECT doc_id, label, {_IMPACT_COLS} FROM fw3),
lg AS (UNPIVOT wide ON {", ".join(M.IMPACT_FEATURES)} INTO NAME feature VALUE x),
trl AS (SELECT * FROM lg WHERE {BUCKET} >= 20),
sc AS (SELECT feature, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS std
  FROM trl GROUP BY feature),
trs AS (SELECT doc_id, label, feature, (x - mean) / std AS x FROM trl JOIN sc USING (feature)),
eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT feature, var_pop(x) AS v FROM trs GROUP BY feature)),
gst AS (SELECT label, feature, avg(x) AS mean, var_pop(x) + (SELECT eps FROM eps) AS var FROM trs GROUP BY ALL),
cls AS (SELECT label, count(*) AS n_docs FROM wide WHERE {BUCKET} >= 20 GROUP BY label),
pri AS (SELECT label, ln(n_docs / sum(n_docs) OVER ()) AS log_prior FROM cls),
als AS (SELECT doc_id, feature, (x - mean) / std AS x FROM lg JOIN sc USING (feature)),
jl AS (SELECT a.doc_id, g.label, sum(-0.5 * ln(2 * pi() * g.var) - 0.5 * pow(a.x - g.mean, 2) / g.var) AS s
  FROM als a JOIN gst g USING (feature) GROUP BY ALL),
jll AS (SELECT jl.doc_id, jl.label, s + log_prior AS j FROM jl JOIN pri USING (label)),
sm AS (SELECT doc_id, label, j, exp(j - max(j) OVER (PARTITION BY doc_id)) AS e FROM jll),
pr AS (SELECT doc_id, label, j, e / sum(e) OVER (PARTITION BY doc_id) AS p,
  row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, label) AS rn FROM sm),
pred AS (SELECT doc_id, label AS predicted_class, p AS confidence FROM pr WHERE rn = 1)
"""


# ---------------------------------------------------------------- vocabulary

@register("X1_vocabulary", TYPE_CTE + "SELECT term, idx, df, tf FROM vocab")
def x1_vocab(spark, sf):
    return M.type_vocabulary(spark, sf)


@register("X2_binary_incidence", TYPE_CTE + """
SELECT doc_id, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(idx) AS BIGINT) AS idx_sum
FROM dt JOIN vocab USING (term) GROUP BY doc_id""")
def x2_binary(spark, sf):
    p = M.type_pipeline(spark, sf)
    return p.terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.sum("idx").alias("idx_sum"))


@register("X3_term_counts", TYPE_CTE + """
SELECT doc_id, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * idx) AS BIGINT) AS weighted
FROM dt JOIN vocab USING (term) GROUP BY doc_id""")
def x3_counts(spark, sf):
    p = M.type_pipeline(spark, sf)
    return p.terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.sum("n").alias("total"),
                                   F.sum(F.col("n") * F.col("idx")).alias("weighted"))


@register("X4_tfidf", SENT_CTE + f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS nnz, round(max(w), {R}) AS max_w, round(sum(w * w), {R}) AS sq_norm
FROM tf GROUP BY doc_id""")
def x4_tfidf(spark, sf):
    p = M.sentiment_pipeline(spark, sf)
    return _r(VO.weight_profile(p.weighted))


@register("X5_vocab_profile", TYPE_CTE + f"""
SELECT 'size' AS item, CAST(count(*) AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS term FROM vocab
UNION ALL SELECT 'top_df', df, term FROM (SELECT * FROM vocab ORDER BY df DESC, term LIMIT 20)
UNION ALL SELECT 'density_x1e6', CAST(round(avg(nnz) * 1e6 / (SELECT count(*) FROM vocab)) AS BIGINT), NULL
  FROM (SELECT doc_id, count(*) AS nnz FROM dt JOIN vocab USING (term) GROUP BY doc_id)""")
def x5_profile(spark, sf):
    p = M.type_pipeline(spark, sf)
    v = p.vocab
    size = v.agg(F.count(F.lit(1)).alias("value")).select(F.lit("size").alias("item"), "value",
                                                           F.lit(None).cast("string").alias("term"))
    top = v.orderBy(F.col("df").desc(), "term").limit(20).select(F.lit("top_df").alias("item"),
                                                                  F.col("df").alias("value"), "term")
    nnz = p.terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"))
    vs = size.first()["value"]  # one scalar
    dens = nnz.agg(F.avg("nnz").alias("a")).select(
        F.lit("density_x1e6").alias("item"), F.round(F.col("a") * 1e6 / F.lit(vs)).cast("bigint").alias("value"),
        F.lit(None).cast("string").alias("term"))
    return size.unionByName(top).unionByName(dens)


# ---------------------------------------------------------------- L1, L2, L3, L13, L14, L20 (type model)

@register("L1_stratified_split", """
WITH c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT label, 'validation' AS split, CAST(round(n * 0.2) AS BIGINT) AS n FROM c
UNION ALL SELECT label, 'train', CAST(n - round(n * 0.2) AS BIGINT) FROM c""")
def l1_split(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("string").alias("label"))
    return EV.stratified_split(lab).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@register("L2_bernoulli_fit", TYPE_CTE + f"""
SELECT label, term, round(log_p, {R}) AS log_p, round(log_1mp, {R}) AS log_1mp, round(log_prior, {R}) AS log_prior
FROM theta""")
def l2_fit(spark, sf):
    p = M.type_pipeline(spark, sf)
    return _r(p.model.theta.join(F.broadcast(p.model.prior.select("label", "log_prior")), "label"))


@register("L3_bernoulli_score", TYPE_CTE + f"""
SELECT doc_id, predicted_class, round(confidence, {R}) AS confidence FROM pred""")
def l3_score(spark, sf):
    p = M.type_pipeline(spark, sf)
    return _r(p.pred.select("doc_id", "predicted_class", "confidence"))


@register("L13_metrics", TYPE_CTE + f"""
, ev AS (SELECT d.label AS t, p.predicted_class AS p FROM pred p JOIN (SELECT DISTINCT doc_id, label FROM d) d
  USING (doc_id) WHERE {BUCKET} < 20),
pc AS (SELECT c AS cls, sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS support, sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS npred,
  sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) AS tp
  FROM ev CROSS JOIN (SELECT t AS c FROM ev UNION SELECT p FROM ev) GROUP BY c),
pm AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM pc),
pf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pm)
SELECT round(sum(tp) / sum(support), {R}) AS accuracy, round(sum(pr * support) / sum(support), {R}) AS precision,
  round(sum(rc * support) / sum(support), {R}) AS recall, round(sum(f1 * support) / sum(support), {R}) AS f1,
  CAST(sum(support) AS BIGINT) AS n FROM pf""")
def l13_metrics(spark, sf):
    p = M.type_pipeline(spark, sf)
    _, va = EV.train_validation_split(p.docs)
    ev = va.join(p.pred.select("doc_id", "predicted_class"), "doc_id")
    return _r(EV.classification_metrics(ev))


@register("L14_training_metadata", TYPE_CTE + """
SELECT label, CAST(n_docs AS BIGINT) AS class_count, CAST(sum(n_docs) OVER () AS BIGINT) AS samples,
  CAST((SELECT count(*) FROM vocab) AS BIGINT) AS features FROM cls""")
def l14_meta(spark, sf):
    p = M.type_pipeline(spark, sf)
    n_features = p.vocab.count()
    return EV.training_metadata(p.train_docs, n_features)


@register("L20_relevant_terms", TYPE_CTE + """
, pt AS (SELECT dt.doc_id, dt.term, t.log_p,
  row_number() OVER (PARTITION BY dt.doc_id ORDER BY t.log_p DESC, dt.term) AS rn
  FROM dt JOIN pred p ON p.doc_id = dt.doc_id JOIN theta t ON t.term = dt.term AND t.label = p.predicted_class)
SELECT doc_id, array_to_string(list(term ORDER BY rn), '|') AS relevant_terms FROM pt WHERE rn <= 5 GROUP BY doc_id""")
def l20_terms(spark, sf):
    p = M.type_pipeline(spark, sf)
    w = p.model.theta.select("label", "term", F.col("log_p").alias("w"))
    rt = NB.relevant_terms(p.pred, p.terms, w, 5)
    return rt.select("doc_id", F.array_join("relevant_terms", "|").alias("relevant_terms"))


# ---------------------------------------------------------------- L4-L6 (sentiment model)

@register("L4_complement_fit", SENT_CTE + f"SELECT label, term, round(w, {R}) AS w FROM cw")
def l4_fit(spark, sf):
    return _r(M.sentiment_pipeline(spark, sf).model.weights)


@register("L5_complement_log1p_l2", SENT_CTE.replace("\npred AS", "\npred_unused AS") + f"""
, ccount AS (SELECT label, (SELECT count(*) FROM trd) - n_docs AS comp_docs FROM cls),
lp AS (SELECT g.label, g.term, ln(1 + (sum(g.fc) OVER (PARTITION BY g.term) - g.fc + 1.0 * (SELECT count(*) FROM cls))
  / c.comp_docs) AS lp FROM grid g JOIN ccount c USING (label))
SELECT label, term, round(lp / sqrt(sum(lp * lp) OVER (PARTITION BY label)), {R}) AS w FROM lp""")
def l5_fit(spark, sf):
    return _r(M.sentiment_pipeline(spark, sf, weighting="log1p_l2").model.weights)


@register("L6_complement_score", SENT_CTE + f"""
SELECT doc_id, predicted_class, round(confidence, {R}) AS confidence FROM pred""")
def l6_score(spark, sf):
    return _r(M.sentiment_pipeline(spark, sf).pred.select("doc_id", "predicted_class", "confidence"))


# ---------------------------------------------------------------- L7-L11, L17, L19, L21, L24 (impact model)

@register("L7_standard_scaling", IMPACT_MODEL_CTE + f"""
SELECT feature, round(mean, {R}) AS mean, round(std, {R}) AS std FROM sc""")
def l7_scaling(spark, sf):
    return _r(M.impact_pipeline(spark, sf).model.scaler)


@register("L8_gaussian_fit", IMPACT_MODEL_CTE + f"""
SELECT label, feature, round(mean, {R}) AS mean, round(var, {R}) AS var FROM gst""")
def l8_fit(spark, sf):
    return _r(M.impact_pipeline(spark, sf).model.stats)


@register("L9_gaussian_score", IMPACT_MODEL_CTE + f"""
SELECT doc_id, predicted_class, round(confidence, {R}) AS confidence FROM pred""")
def l9_score(spark, sf):
    return _r(M.impact_pipeline(spark, sf).pred.select("doc_id", "predicted_class", "confidence"))


IMPORTANCE_SQL = """
, imp0 AS (SELECT a.feature, sum(abs(a.mean - b.mean) / (sqrt((a.var + b.var) / 2.0) + 1e-10)) AS v
  FROM gst a JOIN gst b ON a.feature = b.feature AND a.label < b.label GROUP BY a.feature),
imp AS (SELECT f.feature, CASE WHEN sum(coalesce(v, 0)) OVER () > 0 THEN coalesce(v, 0) / sum(coalesce(v, 0)) OVER ()
  ELSE 1.0 / count(*) OVER () END AS importance
  FROM (SELECT DISTINCT feature FROM gst) f LEFT JOIN imp0 USING (feature))
"""


@register("L10_feature_importance", IMPACT_MODEL_CTE + IMPORTANCE_SQL + f"""
SELECT feature, round(importance, {R}) AS importance FROM imp""")
def l10_importance(spark, sf):
    return _r(NB.feature_importance(M.impact_pipeline(spark, sf).model))


@register("L11_select_k_best", IMPACT_MODEL_CTE + """
, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m FROM trl GROUP BY ALL),
gm AS (SELECT feature, avg(x) AS gm, count(*) AS nn, count(DISTINCT label) AS k FROM trl GROUP BY feature),
ssb AS (SELECT feature, sum(n * pow(m - gm, 2)) AS ssb FROM g JOIN gm USING (feature) GROUP BY feature),
ssw AS (SELECT t.feature, sum(pow(x - m, 2)) AS ssw FROM trl t JOIN g ON g.feature = t.feature AND g.label = t.label
  GROUP BY t.feature),
fs AS (SELECT feature, CASE WHEN ssw > 1e-9 THEN (ssb / (k - 1)) / (ssw / (nn - k)) END AS f_score
  FROM ssb JOIN ssw USING (feature) JOIN gm USING (feature)),
fr AS (SELECT feature, f_score, floor(log10(f_score)) AS e FROM fs WHERE f_score > 0
  UNION ALL SELECT feature, f_score, NULL FROM fs WHERE NOT coalesce(f_score > 0, false)),
rk AS (SELECT feature, row_number() OVER (ORDER BY e DESC NULLS LAST, round(f_score / pow(10, e), 8) DESC NULLS LAST, feature) AS rank
  FROM fr)
SELECT feature, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 10""")
def l11_kbest(spark, sf):
    p = M.impact_pipeline(spark, sf)
    train_long, _ = EV.train_validation_split(p.long)
    top = NB.select_k_best(NB.anova_f(train_long), 10)
    from pyspark.sql import Window
    return top.select("feature", F.row_number().over(Window.orderBy(*NB.f_rank()))
                      .cast("bigint").alias("rank"))


PROBS_LONG_SQL = """
, pl AS (SELECT pr.doc_id, pr.label AS class, pr.p AS prob, w.label AS true_class
  FROM pr JOIN (SELECT DISTINCT doc_id, label FROM wide) w USING (doc_id))
"""


def _impact_probs_long(spark, sf):
    p = M.impact_pipeline(spark, sf)
    return NB.probabilities_long(p.pred).join(p.docs.withColumnRenamed("label", "true_class"), "doc_id")


@register("L17_threshold_sweep", IMPACT_MODEL_CTE + PROBS_LONG_SQL + """
, th AS (SELECT unnest([0.30e0, 0.35e0, 0.40e0, 0.45e0, 0.50e0, 0.55e0, 0.60e0, 0.65e0, 0.70e0, 0.75e0, 0.80e0, 0.85e0,
  0.90e0]) AS threshold),
ag AS (SELECT class, threshold, sum(CASE WHEN prob >= threshold AND true_class = class THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN prob >= threshold AND true_class <> class THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN prob < threshold AND true_class = class THEN 1 ELSE 0 END) AS fn FROM pl CROSS JOIN th GROUP BY ALL),
ap AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM ag),
af AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM ap),
best AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, threshold) AS rn FROM af)
SELECT class, CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, round(f1, 6) AS best_f1 FROM best WHERE rn = 1""")
def l17_sweep(spark, sf):
    return _r(EV.threshold_sweep(_impact_probs_long(spark, sf)))


# FIXED VALUES: readable class names of the three models.
READABLE = {"high": "Alto Impacto", "medium": "Médio Impacto", "low": "Baixo Impacto",
            "positive": "Positivo", "negative": "Negativo", "neutral": "Neutro"}


@register("L19_readable_labels", IMPACT_MODEL_CTE + """
SELECT CASE predicted_class WHEN 'high' THEN 'Alto Impacto' WHEN 'medium' THEN 'Médio Impacto'
  WHEN 'low' THEN 'Baixo Impacto' ELSE predicted_class END AS readable_class, CAST(count(*) AS BIGINT) AS n
FROM pred GROUP BY 1""")
def l19_readable(spark, sf):
    p = M.impact_pipeline(spark, sf)
    return p.pred.select(NB.readable_label(F.col("predicted_class"), READABLE).alias("readable_class")) \
        .groupBy("readable_class").agg(F.count(F.lit(1)).alias("n"))


@register("L21_top_model_features", IMPACT_MODEL_CTE + IMPORTANCE_SQL + """
, top5 AS (SELECT array_to_string(list(feature ORDER BY importance DESC, feature), '|') AS top_features
  FROM (SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 5))
SELECT doc_id, predicted_class, top_features FROM pred CROSS JOIN top5""")
def l21_top(spark, sf):
    p = M.impact_pipeline(spark, sf)
    imp = NB.feature_importance(p.model).orderBy(F.col("importance").desc(), "feature").limit(5)
    top = imp.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        (-F.col("importance")).alias("k"), F.col("feature")))), lambda s: s["feature"]), "|").alias("t")).first()["t"]
    return p.pred.select("doc_id", "predicted_class", F.lit(top).alias("top_features"))  # 5 names, bounded


@register("L24_roc_auc", IMPACT_MODEL_CTE + PROBS_LONG_SQL + """
, v AS (SELECT class, prob, count(*) AS c, sum(CASE WHEN true_class = class THEN 1 ELSE 0 END) AS cp FROM pl GROUP BY ALL),
rk AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY class ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + (c + 1) / 2.0 AS avg_rank FROM v),
s AS (SELECT class, sum(avg_rank * cp) AS rs, sum(cp) AS npos, sum(c) AS n FROM rk GROUP BY class)
SELECT class, round(CASE WHEN npos > 0 AND n - npos > 0 THEN (rs - npos * (npos + 1) / 2.0) / (npos * (n - npos)) END, 6)
  AS auc FROM s""")
def l24_auc(spark, sf):
    return _r(EV.one_vs_rest_auc(_impact_probs_long(spark, sf)))


# ---------------------------------------------------------------- X6 models over text and numeric features

def _numeric_rows_sql(oracle: str, names: list[str]) -> str:
    cols = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)
    return f"""nw AS (SELECT doc_id, {cols} FROM ({oracle})),
nr AS (SELECT n.doc_id, d.label, '#' || name AS term, x AS w FROM (UNPIVOT nw ON {", ".join(names)} INTO NAME name VALUE x) n JOIN d ON d.doc_id = n.doc_id WHERE x <> 0),
uv AS (SELECT term FROM vocab UNION ALL SELECT unnest([{", ".join(f"'#{n}'" for n in names)}]))"""


_UNION_TYPE_SQL = (FX.ctes("ann") + "," + _terms_sql("ann", sql_norm_variant("text", "type"), "type_label", 2, 2, 1000) + ",\n"
                   + _numeric_rows_sql(ORACLES["F4_F6_type_indicators"], M.TYPE_NUMERIC) + """,
udt AS (SELECT doc_id, label, term FROM dt JOIN vocab USING (term) UNION ALL SELECT doc_id, label, term FROM nr),
utr AS (SELECT * FROM udt WHERE """ + BUCKET + " >= 20)" + _BERNOULLI_SQL.replace("FROM tr JOIN vocab USING (term)", "FROM utr")
                   .replace("FROM vocab v", "FROM uv v").replace("FROM dt JOIN theta", "FROM udt dt JOIN theta"))
_UNION_SENT_SQL = SENT_CTE.replace("fcs AS (", _numeric_rows_sql(
    f"SELECT * FROM ({ORACLES['F10_lexicon_density']}) JOIN ({ORACLES['F11_modifier_counts']}) USING (doc_id)", M.SENTIMENT_NUMERIC) + """,
utf AS (SELECT doc_id, label, term, w FROM tf UNION ALL SELECT doc_id, label, term, w FROM nr),
fcs AS (""", 1).replace("FROM tf WHERE doc_id IN", "FROM utf WHERE doc_id IN").replace(
    "AS fc FROM vocab v CROSS JOIN cls", "AS fc FROM uv v CROSS JOIN cls").replace("AS v FROM tf JOIN cw", "AS v FROM utf tf JOIN cw")


def _stored(spark, tables: dict, meta: dict) -> dict:
    """Model tables written and read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import model_store as MS
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    MS.save_model(spark, path, tables, meta)
    return MS.load_model(spark, path, list(tables))[0]


@register("X6_union_type_scores", _UNION_TYPE_SQL + f"SELECT doc_id, predicted_class, round(confidence, {R}) AS confidence FROM pred")
def x6_union_type(spark, sf):
    """Document type from terms and indicator counts, scored with the model read back from its tables."""
    model, rows, docs = M.type_union_model(spark, sf)
    t = _stored(spark, {"prior": model.prior, "theta": model.theta}, {"model": "bernoulli", "classes": model.classes})
    pred = NB.bernoulli_score(NB.BernoulliModel(model.classes, t["prior"], t["theta"]), rows, docs.select("doc_id"))
    return _r(pred.select("doc_id", "predicted_class", "confidence"))


@register("X6_union_sentiment_scores", _UNION_SENT_SQL + f"SELECT doc_id, predicted_class, round(confidence, {R}) AS confidence FROM pred")
def x6_union_sentiment(spark, sf):
    """Sentiment from TF-IDF terms and lexicon and modifier features, scored with the model read back from its tables."""
    model, rows, docs = M.sentiment_union_model(spark, sf)
    t = _stored(spark, {"weights": model.weights}, {"model": "complement", "classes": model.classes})
    pred = NB.complement_score(NB.ComplementModel(model.classes, t["weights"]), rows, docs.select("doc_id"))
    return _r(pred.select("doc_id", "predicted_class", "confidence"))
