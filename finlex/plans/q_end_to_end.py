"""From texts through the three trained models to the network's decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bayesnet as BN
from ..operators import meta as MT
from ..sources import fixtures as FX
from . import models as M
from .q_bayes import _ACT, _EXT, _REC, MAPPED_SQL
from .q_models import ANN_TYPE_CTE, IMPACT_MODEL_CTE, SENT_CTE
from .registry import register

R = 6


def model_outputs(spark, sf) -> DataFrame:
    """(doc_id, model, predicted_class, confidence) of the three models fitted on the announcements."""
    a = FX.ann_texts(spark, sf)
    labelled = a.select("doc_id", "text", F.col("type_label").alias("label"))
    pred = {"type_classifier": M.type_pipeline(spark, sf, labelled).pred,
            "sentiment_analyzer": M.sentiment_pipeline(spark, sf).pred, "impact_modeler": M.impact_pipeline(spark, sf).pred}
    # nine digits: the last ones of a sum depend on the order of its terms
    return reduce(DataFrame.unionByName, [p.select("doc_id", F.lit(m).alias("model"), "predicted_class",
                                                   F.round("confidence", 9).alias("confidence")) for m, p in pred.items()])


_OUT = "SELECT doc_id, '{m}' AS model, predicted_class, round(confidence, 9) AS confidence FROM ({cte} SELECT * FROM pred)"
E2E_SQL = ("WITH preds AS (" + "\nUNION ALL ".join([
    _OUT.format(m="type_classifier", cte=ANN_TYPE_CTE), _OUT.format(m="sentiment_analyzer", cte=SENT_CTE),
    _OUT.format(m="impact_modeler", cte=IMPACT_MODEL_CTE)]) + "),\n" + "mapped AS" + MAPPED_SQL.partition("mapped AS")[2])


@register("P1_documents_to_decision", E2E_SQL + f"""
, dec AS (SELECT e.doc_id, c.state AS market_direction, c.p AS conf, row_number() OVER (PARTITION BY e.doc_id ORDER BY c.p DESC, c.k) AS rn
  FROM ev e JOIN md_cpt c ON c.s = e.sentiment AND c.i = e.impact),
one AS (SELECT doc_id, max(CASE WHEN model = 'type_classifier' THEN predicted_class END) AS type,
  max(CASE WHEN model = 'sentiment_analyzer' THEN predicted_class END) AS sentiment,
  max(CASE WHEN model = 'impact_modeler' THEN predicted_class END) AS impact,
  avg(CASE WHEN confidence > 0 THEN confidence END) AS overall_confidence FROM preds GROUP BY doc_id)
SELECT doc_id, type, sentiment, impact, round(overall_confidence, {R}) AS overall_confidence, market_direction,
  {_REC} AS recommendation, {_EXT} AS extended_recommendation,
  'A análise recomenda ' || {_ACT} || ' com confiança ' || CASE WHEN conf > 0.8 THEN 'alta' WHEN conf > 0.6 THEN 'moderada' ELSE 'baixa' END
  || ' (' || printf('%.1f', round(conf * 100, 1)) || '%). O horizonte de investimento sugerido é de imediato com nível de risco muito alto.'
  AS summary
FROM dec JOIN one USING (doc_id) WHERE rn = 1""")
def p1_end_to_end(spark, sf):
    """Announcements -> three fitted models -> evidence -> posterior -> decision, stacked vote and explanation."""
    out = model_outputs(spark, sf).checkpoint()  # read by the evidence and by the vote
    dec = BN.decision_table(BN.evidence(BN.mapped_outputs(out)), spark)
    vote = MT.rule_stacking(out)
    return dec.join(vote, "doc_id").select(
        "doc_id", "type", "sentiment", "impact", F.round("overall_confidence", R).alias("overall_confidence"), "market_direction",
        "recommendation", BN.recommendation(F.col("market_direction"), extended=True).alias("extended_recommendation"), "summary")
