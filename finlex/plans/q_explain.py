"""Queries for explanations (E1-E7) and calendar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as CAL
from ..functions import explain as EX
from ..functions import features as FE
from ..functions import terms as T
from ..functions import text as TX
from ..operators import naive_bayes as NB
from ..sources import fixtures as FX
from ..sources import tables as S
from .q_features import BASE_SQL, IMPACT_CTE, NUM_CTE
from .q_models import READABLE
from .registry import q, register

R = 6
PREDS_SQL = BASE_SQL.replace("WITH ann AS", "WITH ann AS", 1).replace(
    "\n, base AS", "\n, base AS", 1) + ", " + FX.PREDS_LONG_SQL.join(["preds_long AS (", ")"]) + """,
pw AS (SELECT DISTINCT doc_id, model, predicted_class, confidence FROM preds_long)
"""


def _pred(spark, sf, model):
    return FX.preds(spark, sf).filter(F.col("model") == model).select("doc_id", "predicted_class", "confidence",
                                                                      "probabilities")


def _sent_base(spark, sf):
    a = FX.ann_texts(spark, sf).select("doc_id", TX.normalize_variant("text", "sentiment").alias("st"))
    return a.join(_pred(spark, sf, "sentiment_analyzer"), "doc_id")


def _sql_list(xs):
    return "[" + ", ".join(q(x) for x in xs) + "]"


_LEX_SQL = (f"CASE p.predicted_class WHEN 'positive' THEN {_sql_list(T.DEFAULT_LEXICON['positive'])} "
            f"WHEN 'negative' THEN {_sql_list(T.DEFAULT_LEXICON['negative'])} "
            f"ELSE {_sql_list(T.DEFAULT_LEXICON['neutral'])} END")
E1_EXPR = f"list_slice(list_filter({_LEX_SQL}, lambda x: contains(b.st, x)), 1, 10)"


@register("E1_lexicon_terms_found", PREDS_SQL + f"""
SELECT b.doc_id, array_to_string({E1_EXPR}, '|') AS terms
FROM base b JOIN pw p ON p.doc_id = b.doc_id AND p.model = 'sentiment_analyzer'""")
def e1_terms(spark, sf):
    b = _sent_base(spark, sf)
    return b.select("doc_id", F.array_join(EX.lexicon_terms_found("st", "predicted_class"), "|").alias("terms"))


def _neg_sql():
    parts = []
    for neg in T.NEGATION_TERMS:
        pat = rf"{neg}{TX.SPACE}+({TX.WORD_CHAR}+{TX.SPACE}+){{0,5}}({TX.WORD_CHAR}+)"
        parts.append(f"list_transform(regexp_extract_all(st, {q(pat)}, 2), lambda w: {q(neg + ' ... ')} || w)")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def _int_sql():
    parts = [f"list_transform(regexp_extract_all(st, {q(f"{i}{TX.SPACE}+({TX.WORD_CHAR}+)")}, 1), "
             f"lambda w: {q(i + ' ')} || w)" for i in T.INTENSIFIERS]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


@register("E2_E3_modifier_phrases", BASE_SQL + f"""
SELECT doc_id, array_to_string(list_slice({_neg_sql()}, 1, 5), '|') AS negation_phrases,
  array_to_string(list_slice({_int_sql()}, 1, 5), '|') AS intensifier_phrases FROM base""")
def e2_e3(spark, sf):
    a = FX.ann_texts(spark, sf).select("doc_id", TX.normalize_variant("text", "sentiment").alias("st"))
    return a.select("doc_id", F.array_join(EX.negation_phrases("st"), "|").alias("negation_phrases"),
                    F.array_join(EX.intensifier_phrases("st"), "|").alias("intensifier_phrases"))


_LEVEL_SQL = ("CASE " + " ".join(f"WHEN p1 - p2 > {th} THEN {q(lab)}" for th, lab in EX.MARGIN_LEVELS)
              + f" ELSE {q(EX.MARGIN_DEFAULT)} END")


@register("E4_top_two_margin", PREDS_SQL + f"""
, r AS (SELECT doc_id, model, class, prob, row_number() OVER (PARTITION BY doc_id, model ORDER BY prob DESC, class) AS rn
  FROM preds_long),
t AS (SELECT doc_id, model, max(CASE WHEN rn = 1 THEN class END) AS first, max(CASE WHEN rn = 1 THEN prob END) AS p1,
  max(CASE WHEN rn = 2 THEN class END) AS second, coalesce(max(CASE WHEN rn = 2 THEN prob END), 0.0) AS p2
  FROM r GROUP BY ALL)
SELECT doc_id, model, first, second, round(p1 - p2, {R}) AS margin, {_LEVEL_SQL} AS level FROM t""")
def e4_margin(spark, sf):
    p = FX.preds(spark, sf).select("doc_id", "model", EX.top_two("probabilities").alias("t"))
    return p.select("doc_id", "model", "t.first", "t.second", F.round("t.margin", R).alias("margin"), "t.level")


_READ_SQL = ("CASE p.predicted_class " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in READABLE.items())
             + " ELSE p.predicted_class END")


@register("E5_sentiment_summary", PREDS_SQL + f"""
, s AS (SELECT b.doc_id, {_READ_SQL} AS readable, p.confidence AS c, {E1_EXPR} AS terms
  FROM base b JOIN pw p ON p.doc_id = b.doc_id AND p.model = 'sentiment_analyzer')
SELECT doc_id, CASE readable WHEN 'Positivo' THEN 'O texto apresenta um sentimento predominantemente positivo'
  WHEN 'Negativo' THEN 'O texto apresenta um sentimento predominantemente negativo'
  ELSE 'O texto apresenta um sentimento neutro ou balanceado' END || ' (confiança '
  || CASE WHEN c > 0.8 THEN 'alta' WHEN c > 0.6 THEN 'moderada' ELSE 'baixa' END || ': '
  || printf('%.1f', round(c * 100, 1)) || '%)'
  || CASE WHEN len(terms) > 0 THEN '. Termos relevantes: ' || array_to_string(terms, ', ') ELSE '' END AS summary
FROM s""")
def e5_summary(spark, sf):
    b = _sent_base(spark, sf)
    readable = NB.readable_label(F.col("predicted_class"), READABLE)
    return b.select("doc_id", EX.sentiment_summary(readable, F.col("confidence"),
                                                   EX.lexicon_terms_found("st", "predicted_class")).alias("summary"))


def _impact_base(spark, sf):
    a = FX.ann_texts(spark, sf).select("doc_id", TX.normalize_variant("text", "impact").alias("it"))
    x = FE.with_impact_features(a, "it").select("doc_id", "percentage_count", "high_impact_count", "predominant_timeframe")
    return x.join(_pred(spark, sf, "impact_modeler"), "doc_id")


_TOP = "greatest(short_term_count, medium_term_count, long_term_count)"
FACTORS_SQL = PREDS_SQL + NUM_CTE + IMPACT_CTE + f"""
, fx AS (SELECT p.doc_id, len(p.pc) AS pcount, i.high_impact_count AS hc,
  CASE WHEN {_TOP} = 0 THEN 'none' WHEN short_term_count = {_TOP} THEN 'short'
       WHEN medium_term_count = {_TOP} THEN 'medium' ELSE 'long' END AS tf
  FROM p JOIN i USING (doc_id)),
fac AS (SELECT doc_id, list_filter([CASE WHEN pcount > 0 THEN 'presença de ' || pcount || ' valores percentuais' END,
  CASE WHEN hc > 0 THEN hc || ' termos indicativos de alto impacto' END,
  CASE WHEN tf <> 'none' THEN 'orientação temporal de ' || CASE tf WHEN 'short' THEN 'curto prazo'
    WHEN 'medium' THEN 'médio prazo' ELSE 'longo prazo' END END], lambda x: x IS NOT NULL) AS factors FROM fx)
"""


@register("E6_impact_factors", FACTORS_SQL + """
SELECT doc_id, array_to_string(factors, '|') AS factors, CAST(len(factors) AS BIGINT) AS n_factors FROM fac""")
def e6_factors(spark, sf):
    b = _impact_base(spark, sf)
    f = {k: F.col(k) for k in ("percentage_count", "high_impact_count", "predominant_timeframe")}
    fac = EX.impact_factors(f)
    return b.select("doc_id", F.array_join(fac, "|").alias("factors"), F.size(fac).cast("bigint").alias("n_factors"))


@register("E7_impact_summary", FACTORS_SQL + f"""
, s AS (SELECT f.doc_id, {_READ_SQL} AS readable, p.confidence AS c, f.factors FROM fac f
  JOIN pw p ON p.doc_id = f.doc_id AND p.model = 'impact_modeler')
SELECT doc_id, 'O texto apresenta um impacto ' || CASE readable """ + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in EX.IMPACT_DESCRIPTOR.items()) + f""" ELSE 'notável' END
  || ' (categoria: ' || readable || ', confiança ' || CASE WHEN c > 0.8 THEN 'alta' WHEN c > 0.6 THEN 'moderada'
  ELSE 'baixa' END || ': ' || printf('%.1f', round(c * 100, 1)) || '%)'
  || CASE WHEN len(factors) > 0 THEN '. Fatores contribuintes: ' || array_to_string(factors, ', ') ELSE '' END
  AS summary FROM s""")
def e7_summary(spark, sf):
    b = _impact_base(spark, sf)
    f = {k: F.col(k) for k in ("percentage_count", "high_impact_count", "predominant_timeframe")}
    readable = NB.readable_label(F.col("predicted_class"), READABLE)
    return b.select("doc_id", EX.impact_summary(readable, F.col("confidence"), EX.impact_factors(f)).alias("summary"))


# ---------------------------------------------------------------- D1-D4 calendar

_D = "CAST(o_orderdate AS DATE)"


def _lw(d):
    return f"({d} - CAST(greatest(isodow({d}) - 5, 0) AS INTEGER))"


@register("D1_last_weekday", f"""
SELECT o_orderkey, {_lw(_D)} AS business_date FROM orders""")
def d1_weekday(spark, sf):
    o = S.table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", CAL.last_weekday(F.col("o_orderdate").cast("date")).alias("business_date"))


_REC = f"({_D} + CAST(o_custkey % 15 + 5 AS INTEGER))"


@register("D2_business_dates", f"""
SELECT o_orderkey, {_lw(f"({_D} + CAST(o_orderkey % 10 AS INTEGER))")} AS meeting_date,
  {_lw(_REC)} AS record_date, {_lw(f"({_lw(_REC)} + CAST(o_orderkey % 20 + 1 AS INTEGER))")} AS payment_date
FROM orders""")
def d2_business(spark, sf):
    o = S.table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    b = CAL.business_dates(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 10).cast("int"),
                           (F.col("o_custkey") % 15 + 5).cast("int"), (F.col("o_orderkey") % 20 + 1).cast("int"))
    return o.select("o_orderkey", b["meeting_date"].alias("meeting_date"), b["record_date"].alias("record_date"),
                    b["payment_date"].alias("payment_date"))


@register("D3_period_labels", f"""
SELECT o_orderkey, quarter({_D}) AS quarter, year({_D}) AS year,
  printf('%dº trimestre de %d', quarter({_D}), year({_D})) AS quarter_label,
  'ano fiscal de ' || year({_D}) AS fiscal_year,
  CASE WHEN month({_D}) <= 6 THEN 'primeiro' ELSE 'segundo' END || ' semestre de ' || year({_D}) AS semester
FROM orders""")
def d3_labels(spark, sf):
    o = S.table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    p = CAL.period_labels(F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", p["quarter"].cast("bigint").alias("quarter"), p["year"].cast("bigint").alias("year"),
                    p["quarter_label"].alias("quarter_label"), p["fiscal_year"].alias("fiscal_year"),
                    p["semester"].alias("semester"))


@register("D4_text_dates", f"SELECT o_orderkey, strftime({_D}, '%d/%m/%Y') AS date_text FROM orders")
def d4_text(spark, sf):
    o = S.table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", CAL.br_date(F.col("o_orderdate").cast("date")).alias("date_text"))
