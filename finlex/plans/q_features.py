"""Queries for the feature operators F1-F24 and entity extraction T8.

Inputs are the ``ann`` announcements (Portuguese finance text, one per order)
or ``documents``.  The three normalised variants are projected once and the
features read those columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as EN
from ..functions import features as FE
from ..functions import terms as T
from ..functions import text as TX
from ..sources import fixtures as FX
from ..sources import tables as S
from .registry import (ORACLES, q, register, sql_contains_any, sql_count_terms, sql_distinct_present,
                       sql_norm_variant, sql_regexp_count, sql_safe_div, sql_ws_words)

R = 6


def ann_texts(spark, sf):
    """``ann`` with the type / sentiment / impact normalised texts (tt, st, it)."""
    a = FX.ann_texts(spark, sf)
    return a.select("doc_id", "text", "source", "doc_date",
                    TX.normalize_variant("text", "type").alias("tt"),
                    TX.normalize_variant("text", "sentiment").alias("st"),
                    TX.normalize_variant("text", "impact").alias("it"))


BASE_SQL = (FX.ctes("ann") + ", base AS (SELECT doc_id, text, source, doc_date, "
            f"{sql_norm_variant('text', 'type')} AS tt, {sql_norm_variant('text', 'sentiment')} AS st, "
            f"{sql_norm_variant('text', 'impact')} AS it FROM ann)\n")


def rounded(features: dict) -> list:
    out = []
    for k, c in features.items():
        out.append(c.alias(k))
    return out


def _round_doubles(df):
    return df.select(*[F.round(F.col(f.name), R).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _rd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {R})"


# ---------------------------------------------------------------- F1-F3

@register("F1_F3_coarse_features", BASE_SQL + "SELECT doc_id, " + ", ".join(
    [f"{sql_contains_any('tt', v)} AS is_{k}" for k, v in T.COARSE_TYPE_INDICATORS.items()]
    + [f"{sql_distinct_present('tt', T.COARSE_POSITIVE)} AS positive_count",
       f"{sql_distinct_present('tt', T.COARSE_NEGATIVE)} AS negative_count",
       f"{sql_regexp_count('it', FE.COARSE_PERCENT_RE)} AS percentage_count",
       f"{sql_regexp_count('it', FE.COARSE_CURRENCY_RE)} AS currency_count"]) + " FROM base")
def f1_f3(spark, sf):
    b = ann_texts(spark, sf)
    feats = FE.compose(FE.coarse_type_flags("tt"), FE.coarse_sentiment("tt"), FE.coarse_impact("it"))
    return b.select("doc_id", *rounded(feats))


# ---------------------------------------------------------------- F4-F6

def _sql_first_pos(t, terms):
    parts = [f"CASE WHEN strpos({t}, {q(x)}) > 0 THEN strpos({t}, {q(x)}) - 1 END" for x in terms]
    return "least(" + ", ".join(parts) + ")"


@register("F4_F6_type_indicators", BASE_SQL + "SELECT doc_id, " + ", ".join(
    sum([[f"{sql_contains_any('tt', v)} AS is_{k}", f"{sql_count_terms('tt', v)} AS count_{k}",
          f"CASE WHEN length(tt) > 0 THEN {_rd(_sql_first_pos('tt', v) + ' / length(tt)')} END AS pos_{k}"]
         for k, v in T.TYPE_INDICATORS.items()], [])) + " FROM base")
def f4_f6(spark, sf):
    b = ann_texts(spark, sf)
    return _round_doubles(b.select("doc_id", *rounded(FE.type_indicators("tt"))))


# ---------------------------------------------------------------- F7 structural (documents)

SENT_SQL = ("list_filter(string_split(regexp_replace(trim(coalesce({t}, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'),"
            " chr(1)), lambda s: s <> '')")


@register("F7_structural", f"""
WITH b AS (SELECT doc_id, {SENT_SQL.format(t='text')} AS s,
     list_filter(string_split({sql_norm_variant('text', 'type')}, ' '), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, s, w, list_transform(s, lambda x: CAST(len({sql_ws_words('x')}) AS DOUBLE)) AS lens FROM b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS num_sentences,
  round(CASE WHEN len(s) > 0 THEN list_sum(lens) / len(s) ELSE 0.0 END, {R}) AS avg_sentence_length,
  round(CASE WHEN len(s) > 1 THEN list_var_pop(lens) ELSE 0.0 END, {R}) AS var_sentence_length,
  round(coalesce(list_max(lens), 0.0), {R}) AS max_sentence_length,
  CAST(len(w) AS BIGINT) AS num_words,
  round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0.0 END, {R})
    AS avg_word_length
FROM l""")
def f7_structural(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    b = d.select("doc_id", TX.sentences("text").alias("s"), TX.words(TX.normalize("text")).alias("w"))
    return _round_doubles(FE.with_structural(b, "s", "w"))


# ---------------------------------------------------------------- T8 / F8 entities

def _sql_entity_types():
    return (f"list_transform(regexp_extract_all(text, {q(EN.ENTITY_RE)}), lambda m: "
            f"CASE WHEN regexp_matches(m, {q('^(?:R\\$|US\\$|€|\\$)')}) THEN 'MONEY' "
            f"WHEN regexp_matches(m, {q('^' + EN.DATE_RE + '$')}) THEN 'DATE' "
            f"WHEN regexp_matches(m, '%$') THEN 'PERCENT' ELSE 'CARDINAL' END)")


_GAZ_SQL = "[" + ", ".join(q(g) for g in EN.DEFAULT_GAZETTEER) + "]"
ENT_SQL = (BASE_SQL + ", e AS (SELECT doc_id, list_concat(" + _sql_entity_types()
           + ", list_transform(list_filter(list_filter(string_split(tt, ' '), lambda x: x <> ''), "
           f"lambda x: list_contains({_GAZ_SQL}, x)), lambda x: 'ORG')) AS types, "
           "len(list_filter(string_split(tt, ' '), lambda x: x <> '')) AS nw FROM base)\n")


def _ann_entities(spark, sf):
    b = ann_texts(spark, sf)
    w = b.select("doc_id", "text", TX.words("tt").alias("w"))
    return w.select("doc_id", "w", EN.entities("text", "w").alias("ents"))


@register("T8_entities", ENT_SQL + """
SELECT t AS ent_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs
FROM (SELECT doc_id, unnest(types) AS t FROM e) GROUP BY t""")
def t8_entities(spark, sf):
    e = _ann_entities(spark, sf)
    ex = e.select("doc_id", F.explode("ents").alias("ent"))
    return ex.groupBy(F.col("ent.ent_type").alias("ent_type")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@register("F8_entity_counts", ENT_SQL + "SELECT doc_id, " + ", ".join(
    [f"CAST(len(list_filter(types, lambda x: x = '{k}')) AS BIGINT) AS entity_{k}_count" for k in FE.ENTITY_TYPES]
    + ["CAST(len(types) AS BIGINT) AS total_entities",
       _rd(sql_safe_div("len(list_filter(types, lambda x: x IN ('ORG', 'MONEY', 'PERCENT')))", "nw"))
       + " AS financial_entity_density"]) + " FROM e")
def f8_entities(spark, sf):
    e = _ann_entities(spark, sf)
    return _round_doubles(e.select("doc_id", *rounded(FE.entity_counts("ents", "w"))))


# ---------------------------------------------------------------- F9 metadata flags

@register("F9_metadata_flags", BASE_SQL + "SELECT doc_id, true AS has_source, " + ", ".join(
    [f"contains(lower(source), '{k}') AS source_contains_{k}" for k in FE.SOURCE_KEYS]
    + ["false AS has_doc_type"] + [f"false AS metadata_type_{k}" for k in T.TYPE_INDICATORS]
    + ["true AS has_date"]) + " FROM base")
def f9_metadata(spark, sf):
    b = ann_texts(spark, sf)
    m = b.select("doc_id", FX.ann_metadata(b).alias("md"))
    return m.select("doc_id", *rounded(FE.metadata_flags("md")))


# ---------------------------------------------------------------- F10-F13 sentiment

def _sql_lexicon(t, lex):
    nw = f"len({sql_ws_words(t)})"
    cols = []
    for cat, terms in lex.items():
        cols.append(f"{sql_count_terms(t, terms)} AS {cat}_terms_count")
        cols.append(f"{_rd(sql_safe_div(sql_count_terms(t, terms), nw))} AS {cat}_terms_density")
    return ", ".join(cols)


@register("F10_lexicon_density", BASE_SQL + f"SELECT doc_id, {_sql_lexicon('st', T.DEFAULT_LEXICON)} FROM base")
def f10_lexicon(spark, sf):
    b = ann_texts(spark, sf)
    return _round_doubles(FE.with_lexicon_features(b, "st"))


# FIXED VALUES (test lexicon for the multilingual documents table, FIXTURES.md)
LEXICON_TEST = {"positive": ["the", "que", "und"], "negative": ["los", "die", "les"],
                "neutral": ["and", "des", "von"]}


@register("F10_lexicon_by_lang", f"""
WITH v AS (SELECT lang, {sql_norm_variant("regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')",
                                           'sentiment')} AS st FROM documents),
f AS (SELECT lang, {_sql_lexicon('st', LEXICON_TEST)} FROM v)
SELECT lang, CAST(count(*) AS BIGINT) AS docs,
  CAST(sum(positive_terms_count) AS BIGINT) AS positive_hits,
  CAST(sum(negative_terms_count) AS BIGINT) AS negative_hits,
  CAST(sum(neutral_terms_count) AS BIGINT) AS neutral_hits,
  round(avg(positive_terms_density), 4) AS avg_positive_density,
  round(avg(negative_terms_density), 4) AS avg_negative_density
FROM f GROUP BY lang""")
def f10_by_lang(spark, sf):
    """Minimum slice: read -> validate -> normalise -> lexicon counts -> aggregate by language."""
    d = S.table(spark, sf, "documents", "doc_id", "text", "lang")
    clean, _ = __import__("finlex.functions.validate", fromlist=["x"]).validate_text("text")
    v = d.select("lang", TX.normalize_variant(clean, "sentiment").alias("st"))
    f = FE.with_lexicon_features(v, "st", LEXICON_TEST, keep=("lang",))
    return f.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("positive_terms_count").alias("positive_hits"),
        F.sum("negative_terms_count").alias("negative_hits"),
        F.sum("neutral_terms_count").alias("neutral_hits"),
        F.round(F.avg("positive_terms_density"), 4).alias("avg_positive_density"),
        F.round(F.avg("negative_terms_density"), 4).alias("avg_negative_density"))


@register("F11_modifier_counts", BASE_SQL + "SELECT doc_id, " + ", ".join([
    f"{sql_count_terms('st', T.NEGATION_TERMS)} AS negation_count",
    f"{sql_count_terms('st', T.INTENSIFIERS)} AS intensifier_count",
    f"{sql_count_terms('st', T.DIMINISHERS)} AS diminisher_count"]) + " FROM base")
def f11_modifiers(spark, sf):
    b = ann_texts(spark, sf)
    return b.select("doc_id", *rounded(FE.modifier_counts("st")))


@register("F12_negation_patterns", BASE_SQL + "SELECT doc_id, CAST((" + " + ".join(
    sql_regexp_count("st", FE.negation_pattern(t)) for t in T.NEGATION_TERMS)
    + ") AS BIGINT) AS negation_patterns_count FROM base")
def f12_negation(spark, sf):
    b = ann_texts(spark, sf)
    return b.select("doc_id", *rounded(FE.negation_patterns("st")))


_FUT = sql_count_terms("st", T.FUTURE_INDICATORS)
_PAST = sql_count_terms("st", T.PAST_INDICATORS)


@register("F13_tense", BASE_SQL + f"""
SELECT doc_id, {_FUT} AS future_orientation_count, {_PAST} AS past_orientation_count,
  CASE WHEN {_PAST} > 0 THEN round({_FUT} / {_PAST}, {R}) WHEN {_FUT} > 0 THEN CAST('inf' AS DOUBLE)
       ELSE 1.0 END AS temporal_ratio
FROM base""")
def f13_tense(spark, sf):
    b = ann_texts(spark, sf)
    return _round_doubles(b.select("doc_id", *rounded(FE.tense("st"))))


# ---------------------------------------------------------------- F14-F22 impact

NUM_CTE = (", p AS (SELECT doc_id, it, list_transform(regexp_extract_all(it, "
           f"{q(FE.PERCENT_RE)}, 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS pc FROM base)\n")
NUM_SQL = BASE_SQL + NUM_CTE


@register("F14_F17_numeric", NUM_SQL + f"""
SELECT doc_id, CAST(len(pc) AS BIGINT) AS percentage_count,
  round(coalesce(list_max(pc), 0.0), {R}) AS max_percentage,
  round(coalesce(list_min(pc), 0.0), {R}) AS min_percentage,
  round(CASE WHEN len(pc) > 0 THEN list_sum(pc) / len(pc) ELSE 0.0 END, {R}) AS avg_percentage,
  round(coalesce(list_sum(pc), 0.0), {R}) AS sum_percentage,
  CAST(len(list_filter(pc, lambda x: x >= 15)) AS BIGINT) AS high_percentage_count,
  CAST(len(list_filter(pc, lambda x: x >= 5 AND x < 15)) AS BIGINT) AS medium_percentage_count,
  CAST(len(list_filter(pc, lambda x: x < 5)) AS BIGINT) AS low_percentage_count,
  {sql_regexp_count('it', FE.CURRENCY_RE)} AS currency_count,
  {sql_regexp_count('it', FE.NUMERIC_RE)} AS numeric_value_count,
  {_rd(sql_safe_div(f"len(pc) + {sql_regexp_count('it', FE.CURRENCY_RE)} + {sql_regexp_count('it', FE.NUMERIC_RE)}",
                    f"len({sql_ws_words('it')})"))} AS numerical_density
FROM p""")
def f14_f17(spark, sf):
    b = ann_texts(spark, sf)
    return _round_doubles(b.select("doc_id", *rounded(FE.numeric_features("it"))))


def _sql_impact_terms(t):
    nw = f"len({sql_ws_words(t)})"
    cols = []
    for lvl, terms in T.IMPACT_TERMS.items():
        cols.append(f"{sql_count_terms(t, terms)} AS {lvl}_count")
        cols.append(f"{sql_safe_div(sql_count_terms(t, terms), nw)} AS {lvl}_density")
    return ", ".join(cols)


IMPACT_CTE = (f", i AS (SELECT doc_id, {_sql_impact_terms('it')}, "
              f"{sql_count_terms('it', T.TIME_INDICATORS['short_term'])} AS short_term_count, "
              f"{sql_count_terms('it', T.TIME_INDICATORS['medium_term'])} AS medium_term_count, "
              f"{sql_count_terms('it', T.TIME_INDICATORS['long_term'])} AS long_term_count FROM base)\n")
IMPACT_SQL = BASE_SQL + IMPACT_CTE


@register("F18_F19_impact_terms", IMPACT_SQL + f"""
SELECT doc_id, high_impact_count, medium_impact_count, low_impact_count,
  round(high_impact_density, {R}) AS high_impact_density, round(medium_impact_density, {R}) AS medium_impact_density,
  round(low_impact_density, {R}) AS low_impact_density,
  round(CASE WHEN low_impact_count > 0 THEN high_impact_count / low_impact_count
        ELSE CAST(high_impact_count AS DOUBLE) END, {R}) AS high_to_low_ratio,
  round(CASE WHEN medium_impact_count > 0 THEN high_impact_count / medium_impact_count
        ELSE CAST(high_impact_count AS DOUBLE) END, {R}) AS high_to_medium_ratio
FROM i""")
def f18_f19(spark, sf):
    b = ann_texts(spark, sf)
    return _round_doubles(b.select("doc_id", *rounded(FE.impact_terms("it"))))


_TOP = "greatest(short_term_count, medium_term_count, long_term_count)"
_CODE = (f"CASE WHEN {_TOP} = 0 THEN 0 WHEN short_term_count = {_TOP} THEN 1 "
         f"WHEN medium_term_count = {_TOP} THEN 2 ELSE 3 END")


@register("F20_time_horizon", IMPACT_SQL + f"""
SELECT doc_id, short_term_count, medium_term_count, long_term_count,
  CASE WHEN {_TOP} = 0 THEN 'none' WHEN short_term_count = {_TOP} THEN 'short'
       WHEN medium_term_count = {_TOP} THEN 'medium' ELSE 'long' END AS predominant_timeframe,
  CAST({_CODE} AS BIGINT) AS timeframe_numeric
FROM i""")
def f20_horizon(spark, sf):
    b = ann_texts(spark, sf)
    return b.select("doc_id", *rounded(FE.time_horizon("it")))


@register("F21_F22_composite", BASE_SQL + NUM_CTE + IMPACT_CTE + f"""
, c AS (SELECT i.doc_id,
  least(1.0, (len(list_filter(pc, lambda x: x >= 15)) * 1.5 + len(list_filter(pc, lambda x: x >= 5 AND x < 15)) * 1.0
              + len(list_filter(pc, lambda x: x < 5)) * 0.5) / 10.0) AS pct,
  least(1.0, (high_impact_density * 1.5 + medium_impact_density * 1.0 + low_impact_density * 0.5) * 10.0) AS terms,
  CASE WHEN {_CODE} > 0 THEN (4 - {_CODE}) / 3.0 ELSE 0.5 END AS tscore,
  high_impact_count AS h, low_impact_count AS lo
  FROM i JOIN p ON i.doc_id = p.doc_id)
SELECT doc_id, round(pct, {R}) AS percentage_impact_score, round(terms, {R}) AS terms_impact_score,
  round(tscore, {R}) AS temporal_impact_score,
  round(pct * 0.4 + terms * 0.4 + tscore * 0.2, {R}) AS composite_impact_score,
  round(CASE WHEN h > 0 AND lo > 0 THEN (h * lo) / (h + lo) ELSE 0.0 END, {R}) AS volatility_index
FROM c""")
def f21_f22(spark, sf):
    b = ann_texts(spark, sf)
    f = FE.with_impact_features(b, "it")
    keep = ["percentage_impact_score", "terms_impact_score", "temporal_impact_score",
            "composite_impact_score", "volatility_index"]
    return _round_doubles(f.select("doc_id", *keep))


_F23_GROUPS = ["F4_F6_type_indicators", "F10_lexicon_density", "F11_modifier_counts", "F12_negation_patterns", "F13_tense", "F14_F17_numeric",
               "F18_F19_impact_terms", "F20_time_horizon", "F21_F22_composite"]
# every group's own oracle, joined by document
_F23_SQL = "SELECT * FROM " + " JOIN ".join(f"({ORACLES[g]}) g{i}" + (" USING (doc_id)" if i else "") for i, g in enumerate(_F23_GROUPS))


@register("F23_composed_features", _F23_SQL)
def f23_composed(spark, sf):
    """All feature groups composed by name."""
    b = ann_texts(spark, sf)
    text_feats = FE.with_scanned_text_features(b.select("doc_id", "tt", "st", "it"), "tt", "st",
                                               keep=("doc_id", "it"))
    keep = tuple(c for c in text_feats.columns if c != "it")
    return _round_doubles(FE.with_impact_features(text_feats, "it", keep=keep))


@register("F24_numeric_projection", BASE_SQL + """
SELECT doc_id, CAST(count_relatorio_trimestral AS DOUBLE) AS count_relatorio_trimestral,
  CAST(is_relatorio_trimestral AS DOUBLE) AS is_relatorio_trimestral,
  coalesce(round(pos_relatorio_trimestral, 6), 0.0) AS pos_relatorio_trimestral
FROM (SELECT doc_id, """ + sql_count_terms("tt", T.TYPE_INDICATORS["relatorio_trimestral"])
          + " AS count_relatorio_trimestral, " + sql_contains_any("tt", T.TYPE_INDICATORS["relatorio_trimestral"])
          + " AS is_relatorio_trimestral, CASE WHEN length(tt) > 0 THEN "
          + _sql_first_pos("tt", T.TYPE_INDICATORS["relatorio_trimestral"])
          + " / length(tt) END AS pos_relatorio_trimestral FROM base)")
def f24_numeric(spark, sf):
    b = ann_texts(spark, sf)
    f = FE.type_indicators("tt", {"relatorio_trimestral": T.TYPE_INDICATORS["relatorio_trimestral"]})
    wide = b.select("doc_id", *rounded(f), F.lit("x").alias("label_text"))
    num = FE.numeric_projection(wide, keep=("doc_id",))
    return num.withColumn("pos_relatorio_trimestral", F.round("pos_relatorio_trimestral", R))
