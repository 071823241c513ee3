"""Queries for model selection and calibration (L11, L12, L15, L16, L18) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import naive_bayes as NB
from ..operators import selection as SE
from ..session import materialize
from . import models as M
from .q_models import BUCKET, IMPACT_MODEL_CTE, SENT_CTE
from .registry import register

R = 6

# ---------------------------------------------------------------- L15, L16

_GRID_SQL = f"""
, fo AS (SELECT *, CAST({BUCKET} % 5 AS INTEGER) AS fold FROM lg),
gtr AS (SELECT held, fo.* FROM fo JOIN (SELECT unnest(range(5)) AS held) ON fold <> held),
gsc AS (SELECT held, feature, avg(x) AS m, var_pop(x) AS v, CASE WHEN var_pop(x) > 1e-18 THEN stddev_pop(x) ELSE 1.0 END AS s FROM gtr GROUP BY ALL),
gss AS (SELECT held, label, feature, count(*) AS n, avg((x - m) / s) AS mean, var_pop((x - m) / s) AS v0 FROM gtr JOIN gsc USING (held, feature) GROUP BY ALL),
gan AS (SELECT held, feature, sum(n * mean * mean) AS b, sum(n * v0) AS w, sum(n) AS nn, count(*) AS k FROM gss GROUP BY ALL),
gff AS (SELECT held, feature, CASE WHEN w > 1e-9 THEN (b / (k - 1)) / (w / (nn - k)) ELSE 0 END AS f FROM gan),
gfe AS (SELECT *, CASE WHEN f > 0 THEN floor(log10(CASE WHEN f > 0 THEN f ELSE 1 END)) END AS e FROM gff),
grk AS (SELECT held, feature, row_number() OVER (PARTITION BY held ORDER BY e DESC NULLS LAST, round(f / pow(10, coalesce(e, 0)), 8) DESC, feature) AS rank FROM gfe),
gmx AS (SELECT held, max(v / (s * s)) AS mv FROM gsc GROUP BY held),
gcn AS (SELECT held, label, count(DISTINCT doc_id) AS n FROM gtr GROUP BY ALL),
gcl AS (SELECT held, label, ln(n / sum(n) OVER (PARTITION BY held)) AS lp FROM gcn),
vsg AS (SELECT unnest([1e-11, 1e-10, 1e-9, 1e-8, 1e-7]) AS vs), kg AS (SELECT unnest([5, 10, 15, 20, 25, 30]) AS k),
gjl AS (SELECT fo.doc_id, fo.label AS t, gss.label AS c, vs, rank, lp + sum(-0.5 * ln(2 * pi() * (v0 + vs * mv)) - 0.5 * pow((x - m) / s - mean, 2) / (v0 + vs * mv))
    OVER (PARTITION BY fo.doc_id, gss.label, vs ORDER BY rank) AS j
  FROM fo JOIN gss ON gss.held = fo.fold AND gss.feature = fo.feature JOIN gsc ON gsc.held = fo.fold AND gsc.feature = fo.feature
  JOIN grk ON grk.held = fo.fold AND grk.feature = fo.feature JOIN gmx ON gmx.held = fo.fold
  JOIN gcl ON gcl.held = fo.fold AND gcl.label = gss.label CROSS JOIN vsg),
gpp AS (SELECT vs, k, doc_id, t, c AS p FROM gjl JOIN kg ON rank = least(k, {len(M.IMPACT_FEATURES)})
  QUALIFY row_number() OVER (PARTITION BY vs, k, doc_id ORDER BY j DESC, c) = 1),
gcf AS (SELECT vs, k, t, p, count(*) AS c FROM gpp GROUP BY ALL),
gpc AS (SELECT a.vs, a.k, a.cls, support, coalesce(said, 0) AS said, coalesce(hit, 0) AS hit FROM (SELECT vs, k, t AS cls, sum(c) AS support FROM gcf GROUP BY ALL) a
  LEFT JOIN (SELECT vs, k, p AS cls, sum(c) AS said FROM gcf GROUP BY ALL) b USING (vs, k, cls)
  LEFT JOIN (SELECT vs, k, t AS cls, c AS hit FROM gcf WHERE t = p) h USING (vs, k, cls)),
grid AS (SELECT vs AS var_smoothing, CAST(k AS INTEGER) AS k, sum(2.0 * hit / (support + said) * support) / sum(support) AS f1 FROM gpc GROUP BY ALL)
"""


def _impact(spark, sf):
    return materialize(M.impact_features_wide(spark, sf), "impact")  # read by the sums and the scoring


@register("L15_grid_over_k", IMPACT_MODEL_CTE + _GRID_SQL + f"SELECT var_smoothing, k, round(f1, {R}) AS f1 FROM grid")
def l15_grid_k(spark, sf):
    """30 points of var_smoothing x k, five folds, from one pass of sums and one of scoring."""
    grid = SE.gaussian_grid(_impact(spark, sf), M.IMPACT_FEATURES)
    return grid.select("var_smoothing", "k", F.round("f1", R).alias("f1"))


@register("L16_grid_one_job", SENT_CTE + f"""
, al AS (SELECT unnest([0.1, 0.5, 1.0, 2.0]) AS alpha), nm AS (SELECT unnest([true, false]) AS norm), fp AS (SELECT unnest([true, false]) AS fit_prior),
h2 AS (SELECT alpha, label, term, sum(fc) OVER (PARTITION BY alpha, term) + alpha - fc AS comp FROM grid CROSS JOIN al),
h3 AS (SELECT alpha, label, term, ln(comp / sum(comp) OVER (PARTITION BY alpha, label)) AS logged FROM h2),
hw AS (SELECT alpha, norm, label, term, CASE WHEN norm THEN logged / sum(logged) OVER (PARTITION BY alpha, norm, label) ELSE -logged END AS w FROM h3 CROSS JOIN nm),
vd AS (SELECT doc_id, label FROM d WHERE {BUCKET} < 20),
hj AS (SELECT vd.doc_id, vd.label AS t, hw.alpha, hw.norm, hw.label AS c, sum(tf.w * hw.w) AS j FROM vd JOIN tf ON tf.doc_id = vd.doc_id JOIN hw USING (term) GROUP BY ALL),
hg AS (SELECT vd.doc_id, vd.label AS t, al.alpha, nm.norm, cls.label AS c, coalesce(hj.j, 0.0) AS j FROM vd CROSS JOIN al CROSS JOIN nm CROSS JOIN cls
  LEFT JOIN hj ON hj.doc_id = vd.doc_id AND hj.alpha = al.alpha AND hj.norm = nm.norm AND hj.c = cls.label),
hp AS (SELECT alpha, norm, doc_id, t, c AS p FROM hg QUALIFY row_number() OVER (PARTITION BY alpha, norm, doc_id ORDER BY j DESC, c) = 1),
hc AS (SELECT alpha, norm, t, p, count(*) AS c FROM hp GROUP BY ALL),
hf AS (SELECT a.alpha, a.norm, sum(2.0 * coalesce(hit, 0) / (support + coalesce(said, 0)) * support) / sum(support) AS f1
  FROM (SELECT alpha, norm, t AS cls, sum(c) AS support FROM hc GROUP BY ALL) a
  LEFT JOIN (SELECT alpha, norm, p AS cls, sum(c) AS said FROM hc GROUP BY ALL) b USING (alpha, norm, cls)
  LEFT JOIN (SELECT alpha, norm, t AS cls, c AS hit FROM hc WHERE t = p) h USING (alpha, norm, cls) GROUP BY ALL)
SELECT CAST(alpha AS DOUBLE) AS alpha, norm, fit_prior, round(f1, {R}) AS f1 FROM hf CROSS JOIN fp""")
def l16_one_job(spark, sf):
    """All 16 points of the sentiment grid from one fit and one scoring pass."""
    p = M.sentiment_pipeline(spark, sf)
    _, valid_docs = EV.train_validation_split(p.docs)
    train_docs, _ = EV.train_validation_split(p.docs)
    train_w, _ = EV.train_validation_split(p.labelled)
    _, valid_w = EV.train_validation_split(p.weights)
    return SE.complement_grid(train_w, train_docs, valid_w, valid_docs, p.vocab).withColumn("f1", F.round("f1", R))


# ---------------------------------------------------------------- L12, L18

CALIBRATION = (20, 60)  # buckets of the rows that fit the curves; lower ones are judged, higher ones train


def _newton_sql(steps: int) -> str:
    """The same Newton steps, one CTE each."""
    parts = ["cn AS (SELECT class, sum(y) AS pos, sum(1 - y) AS neg FROM cx GROUP BY class)",
             "ct AS (SELECT cx.*, CASE WHEN y = 1 THEN (pos + 1.0) / (pos + 2.0) ELSE 1.0 / (neg + 2.0) END AS t FROM cx JOIN cn USING (class))",
             "k0 AS MATERIALIZED (SELECT class, 0e0 AS a, ln((pos + 1.0) / (neg + 1.0)) AS b FROM cn)"]
    for i in range(steps):
        parts.append(f"""g{i} AS (SELECT class, a, b, z, 1 / (1 + exp(-(z * a + b))) AS p, t FROM ct JOIN k{i} USING (class)),
s{i} AS (SELECT class, any_value(a) AS a, any_value(b) AS b, sum((p - t) * z) AS ga, sum(p - t) AS gb, sum(p * (1 - p) * z * z) + {SE.RIDGE!r} AS aa,
  sum(p * (1 - p) * z) AS ab, sum(p * (1 - p)) + {SE.RIDGE!r} AS bb FROM g{i} GROUP BY class),
k{i + 1} AS MATERIALIZED (SELECT class, a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM s{i})""")
    return ",\n".join(parts)


_Z = f"greatest(-{SE.LOG_ODDS}, least({SE.LOG_ODDS}, ln(p) - ln(1 - p)))"
_CAL_SQL = IMPACT_MODEL_CTE.replace(f"WHERE {BUCKET} >= 20", f"WHERE {BUCKET} >= {CALIBRATION[1]}") + f"""
, px AS (SELECT pr.doc_id, pr.label AS class, CASE WHEN p <= 0 OR p >= 1 THEN CASE WHEN p <= 0 THEN -{SE.LOG_ODDS} ELSE {SE.LOG_ODDS} END ELSE {_Z} END AS z,
  w.label AS true_class, CASE WHEN w.label = pr.label THEN 1 ELSE 0 END AS y, {BUCKET.replace('doc_id', 'pr.doc_id')} AS bucket
  FROM pr JOIN wide w ON w.doc_id = pr.doc_id),
cx AS (SELECT * FROM px WHERE bucket >= {CALIBRATION[0]} AND bucket < {CALIBRATION[1]}),
{_newton_sql(SE.NEWTON_STEPS)},
cp AS (SELECT px.*, 1 / (1 + exp(-(z * a + b))) AS s FROM px JOIN k{SE.NEWTON_STEPS} USING (class)),
cq AS (SELECT *, s / sum(s) OVER (PARTITION BY doc_id) AS prob FROM cp),
cth AS (SELECT unnest([0.30e0, 0.35e0, 0.40e0, 0.45e0, 0.50e0, 0.55e0, 0.60e0, 0.65e0, 0.70e0, 0.75e0, 0.80e0, 0.85e0, 0.90e0]) AS threshold),
cag AS (SELECT class, threshold, sum(CASE WHEN prob >= threshold THEN y ELSE 0 END) AS tp, sum(CASE WHEN prob >= threshold THEN 1 - y ELSE 0 END) AS fp,
  sum(CASE WHEN prob < threshold THEN y ELSE 0 END) AS fn FROM cq CROSS JOIN cth WHERE bucket >= {CALIBRATION[0]} AND bucket < {CALIBRATION[1]} GROUP BY ALL),
caf AS (SELECT *, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0 END AS f1 FROM cag),
cbt AS (SELECT class, CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold FROM caf QUALIFY row_number() OVER (PARTITION BY class ORDER BY f1 DESC, threshold) = 1),
curves AS (SELECT class, a AS slope, b AS "offset", threshold FROM k{SE.NEWTON_STEPS} JOIN cbt USING (class)),
aft AS (SELECT doc_id, class AS predicted_class, prob AS confidence, true_class FROM cq JOIN cbt USING (class) WHERE bucket < {CALIBRATION[0]}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prob >= threshold DESC, prob DESC, class) = 1)
"""


def _calibration_parts(spark, sf):
    """Model fitted on the training buckets, curves on the calibration buckets, and what is left to judge."""
    wide = _impact(spark, sf)
    b = EV.split_bucket("doc_id")
    train = wide.filter(b >= CALIBRATION[1])
    model = NB.gaussian_fit(NB.unpivot_features(train, M.IMPACT_FEATURES, keep=("doc_id", "label")), train.select("doc_id", "label"))
    # read by the curves, the thresholds and both sides of the comparison
    pred = NB.gaussian_score_wide(model, wide).join(wide.select("doc_id", F.col("label").alias("true_class")), "doc_id").checkpoint()
    long = NB.probabilities_long(pred, ("doc_id", "true_class"))
    curves = SE.fit_calibration(long.filter((b >= CALIBRATION[0]) & (b < CALIBRATION[1])))
    return model, curves, pred.filter(b < CALIBRATION[0])


@register("L12_calibration_curves", _CAL_SQL + f"""SELECT class, round(slope, {R}) AS slope, round("offset", {R}) AS "offset", threshold FROM curves""")
def l12_curves(spark, sf):
    """The calibration table of the impact model."""
    _, curves, _ = _calibration_parts(spark, sf)
    return curves.select("class", F.round("slope", R).alias("slope"), F.round("offset", R).alias("offset"), "threshold")


@register("L12_calibrated_scores", _CAL_SQL + f"SELECT doc_id, predicted_class, round(confidence, {R}) AS confidence FROM aft")
def l12_scores(spark, sf):
    """Calibrated probabilities and thresholds applied to rows that fitted neither model nor curves, after saving and loading."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import model_store as MS
    model, curves, judged = _calibration_parts(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    MS.save_model(spark, path, {"calibration": curves}, {"model": "gaussian", "classes": model.classes})
    tables, _, _ = MS.load_model(spark, path, ["calibration"])
    return SE.calibrated(judged, tables["calibration"]).select("doc_id", "predicted_class", F.round("confidence", R).alias("confidence"))


@register("L18_improvement", _CAL_SQL + f"""
, sides AS (SELECT 'after' AS stage, true_class AS t, predicted_class AS p FROM aft
  UNION ALL SELECT 'before', w.label, pred.predicted_class FROM pred JOIN wide w ON w.doc_id = pred.doc_id WHERE {BUCKET.replace('doc_id', 'pred.doc_id')} < {CALIBRATION[0]}),
bc AS (SELECT stage, t, p, count(*) AS c FROM sides GROUP BY ALL),
bm AS (SELECT a.stage, sum(coalesce(hit, 0)) / sum(support) AS accuracy, sum(2.0 * coalesce(hit, 0) / (support + coalesce(said, 0)) * support) / sum(support) AS f1
  FROM (SELECT stage, t AS cls, sum(c) AS support FROM bc GROUP BY ALL) a
  LEFT JOIN (SELECT stage, p AS cls, sum(c) AS said FROM bc GROUP BY ALL) b USING (stage, cls)
  LEFT JOIN (SELECT stage, t AS cls, c AS hit FROM bc WHERE t = p) h USING (stage, cls) GROUP BY ALL)
SELECT round(x.accuracy, {R}) AS accuracy_before, round(y.accuracy, {R}) AS accuracy_after, round(y.accuracy - x.accuracy, {R}) AS accuracy_improvement,
  round(x.f1, {R}) AS f1_before, round(y.f1, {R}) AS f1_after, round(y.f1 - x.f1, {R}) AS f1_improvement
FROM bm x, bm y WHERE x.stage = 'before' AND y.stage = 'after'""")
def l18_improvement(spark, sf):
    """Metrics before and after calibration on the same rows, which fitted neither, and the difference."""
    _, curves, judged = _calibration_parts(spark, sf)
    both = judged.select(F.lit("before").alias("stage"), F.col("true_class").alias("t"), F.col("predicted_class").alias("p")).unionByName(
        SE.calibrated(judged, curves).select(F.lit("after").alias("stage"), F.col("true_class").alias("t"), F.col("predicted_class").alias("p")))
    m = SE.weighted_f1(both.groupBy("stage", "t", "p").agg(F.count(F.lit(1)).alias("c")), ["stage"])
    of = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))
    return m.agg(*[F.round(e, R).alias(f"{c}_{name}") for c in ("accuracy", "f1") for name, e in (
        ("before", of("before", c)), ("after", of("after", c)), ("improvement", of("after", c) - of("before", c)))])


@register("L15_selected_model", IMPACT_MODEL_CTE + _GRID_SQL + f"""
, pick AS (SELECT var_smoothing AS vs, k FROM grid ORDER BY round(f1, 9) DESC, var_smoothing, k LIMIT 1),
tst AS (SELECT label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS v0 FROM trs GROUP BY ALL),
tan AS (SELECT feature, sum(n * mean * mean) AS b, sum(n * v0) AS w, sum(n) AS nn, count(*) AS c FROM tst GROUP BY ALL),
tff AS (SELECT feature, CASE WHEN w > 1e-9 THEN (b / (c - 1)) / (w / (nn - c)) ELSE 0 END AS f FROM tan),
tfe AS (SELECT *, CASE WHEN f > 0 THEN floor(log10(CASE WHEN f > 0 THEN f ELSE 1 END)) END AS e FROM tff),
trk AS (SELECT feature, row_number() OVER (ORDER BY e DESC NULLS LAST, round(f / pow(10, coalesce(e, 0)), 8) DESC, feature) AS rank FROM tfe),
sel AS (SELECT feature FROM trk WHERE rank <= (SELECT k FROM pick)),
tep AS (SELECT max(v) * (SELECT vs FROM pick) AS eps FROM (SELECT feature, var_pop(x) AS v FROM trs WHERE feature IN (SELECT feature FROM sel) GROUP BY feature)),
tjl AS (SELECT als.doc_id, tst.label, any_value(log_prior) + sum(-0.5 * ln(2 * pi() * (v0 + eps)) - 0.5 * pow(x - mean, 2) / (v0 + eps)) AS j
  FROM als JOIN tst USING (feature) JOIN pri ON pri.label = tst.label CROSS JOIN tep WHERE feature IN (SELECT feature FROM sel) GROUP BY ALL)
SELECT doc_id, label AS predicted_class, (SELECT vs FROM pick) AS var_smoothing, (SELECT k FROM pick) AS k FROM tjl
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, label) = 1""")
def l15_selected(spark, sf):
    """The impact model on the grid's best smoothing and its k best features."""
    p, point = M.selected_impact_pipeline(spark, sf)
    return p.pred.select("doc_id", "predicted_class", F.lit(point["var_smoothing"]).alias("var_smoothing"), F.lit(point["k"]).alias("k"))
