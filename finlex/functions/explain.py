"""Explanations derived from predictions and text (E1-E7), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T
from .text import SPACE, WORD_CHAR, _c

# FIXED VALUES: margin levels and sentence wording.
MARGIN_LEVELS = [(0.5, "muito alta (classificação clara)"), (0.3, "alta (classificação confiável)"),
                 (0.15, "moderada (classificação provável)"), (0.05, "baixa (classificação incerta)")]
MARGIN_DEFAULT = "muito baixa (classificação ambígua)"
SENTIMENT_OPENING = {"Positivo": "O texto apresenta um sentimento predominantemente positivo",
                     "Negativo": "O texto apresenta um sentimento predominantemente negativo"}
SENTIMENT_OPENING_DEFAULT = "O texto apresenta um sentimento neutro ou balanceado"
# FIXED VALUES: impact descriptor word per readable class (first of the reference's lists).
IMPACT_DESCRIPTOR = {"Alto Impacto": "significativo", "Médio Impacto": "moderado", "Baixo Impacto": "limitado"}
IMPACT_DESCRIPTOR_DEFAULT = "notável"
TIMEFRAME_PT = {"short": "curto prazo", "medium": "médio prazo", "long": "longo prazo"}


def _map_lit(d: dict) -> Column:
    return F.create_map(*[x for kv in d.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


def band(conf: Column) -> Column:
    return F.when(conf > 0.8, "alta").when(conf > 0.6, "moderada").otherwise("baixa")


def pct(conf: Column) -> Column:
    """Python ``{:.1%}`` for values in [0, 1]."""
    return F.concat(F.regexp_replace(F.format_number(F.round(conf * 100, 1), 1), ",", ""), F.lit("%"))


def lexicon_terms_found(text: str | Column, predicted: str | Column, limit: int = 10) -> Column:
    """Lexicon terms of the predicted class present in the text, lexicon order, first ``limit``."""
    t, p = _c(text), _c(predicted)
    arr = F.when(p == "positive", F.array(*[F.lit(x) for x in T.DEFAULT_LEXICON["positive"]])) \
        .when(p == "negative", F.array(*[F.lit(x) for x in T.DEFAULT_LEXICON["negative"]])) \
        .otherwise(F.array(*[F.lit(x) for x in T.DEFAULT_LEXICON["neutral"]]))
    return F.slice(F.filter(arr, lambda x: F.contains(t, x)), 1, limit)


def negation_phrases(text: str | Column, limit: int = 5) -> Column:
    """``"<neg> ... <last word>"`` for each negation match, negation-list order, first 5."""
    t = _c(text)
    parts = []
    for neg in T.NEGATION_TERMS:
        pat = rf"{neg}{SPACE}+({WORD_CHAR}+{SPACE}+){{0,5}}({WORD_CHAR}+)"
        parts.append(_prefix(F.regexp_extract_all(t, F.lit(pat), 2), neg + " ... "))
    return F.slice(F.concat(*parts), 1, limit)


def _prefix(arr: Column, prefix: str) -> Column:
    return F.transform(arr, lambda w: F.concat(F.lit(prefix), w))


def intensifier_phrases(text: str | Column, limit: int = 5) -> Column:
    """``"<intensifier> <word>"``, intensifier-list order, first 5."""
    t = _c(text)
    parts = [_prefix(F.regexp_extract_all(t, F.lit(rf"{i}{SPACE}+({WORD_CHAR}+)"), 1), i + " ")
             for i in T.INTENSIFIERS]
    return F.slice(F.concat(*parts), 1, limit)


def margin_level(margin: Column) -> Column:
    """E4 margin interpretation."""
    out = None
    for th, label in MARGIN_LEVELS:
        out = F.when(margin > th, label) if out is None else out.when(margin > th, label)
    return out.otherwise(MARGIN_DEFAULT)


def top_two(probabilities: str | Column) -> Column:
    """STRUCT<first, p1, second, p2, margin, level> from a probability map."""
    e = F.sort_array(F.transform(F.map_entries(_c(probabilities)),
                                 lambda x: F.struct((-x["value"]).alias("k"), x["key"].alias("c"), x["value"].alias("p"))))
    p1 = F.element_at(e, 1)["p"]
    p2 = F.coalesce(F.element_at(e, 2)["p"], F.lit(0.0))
    return F.struct(F.element_at(e, 1)["c"].alias("first"), p1.alias("p1"), F.element_at(e, 2)["c"].alias("second"),
                    p2.alias("p2"), (p1 - p2).alias("margin"), margin_level(p1 - p2).alias("level"))


def sentiment_summary(readable: Column, confidence: Column, terms: Column) -> Column:
    """E5: label sentence with band, percentage and relevant terms."""
    opening = F.coalesce(_map_lit(SENTIMENT_OPENING)[readable], F.lit(SENTIMENT_OPENING_DEFAULT))
    base = F.concat(opening, F.lit(" (confiança "), band(confidence), F.lit(": "), pct(confidence), F.lit(")"))
    return F.when(F.size(terms) > 0, F.concat(base, F.lit(". Termos relevantes: "), F.array_join(terms, ", "))) \
        .otherwise(base)


def impact_factors(f: dict) -> Column:
    """Contributing factors, each present only when its trigger holds."""
    parts = [
        F.when(f["percentage_count"] > 0, F.concat(F.lit("presença de "), f["percentage_count"].cast("string"),
                                                   F.lit(" valores percentuais"))),
        F.when(f["high_impact_count"] > 0, F.concat(f["high_impact_count"].cast("string"),
                                                    F.lit(" termos indicativos de alto impacto"))),
        F.when(f["predominant_timeframe"] != "none", F.concat(
            F.lit("orientação temporal de "),
            F.coalesce(_map_lit(TIMEFRAME_PT)[f["predominant_timeframe"]], f["predominant_timeframe"]))),
    ]
    return F.array_compact(F.array(*parts))


def impact_summary(readable: Column, confidence: Column, factors: Column) -> Column:
    """Deterministic descriptor, label, band and factors."""
    desc = F.coalesce(_map_lit(IMPACT_DESCRIPTOR)[readable], F.lit(IMPACT_DESCRIPTOR_DEFAULT))
    base = F.concat(F.lit("O texto apresenta um impacto "), desc, F.lit(" (categoria: "), readable,
                    F.lit(", confiança "), band(confidence), F.lit(": "), pct(confidence), F.lit(")"))
    return F.when(F.size(factors) > 0, F.concat(base, F.lit(". Fatores contribuintes: "), F.array_join(factors, ", "))) \
        .otherwise(base)
