"""Scalar feature operators F1-F24 as named Column expressions.

Each builder returns an ordered ``dict[name, Column]`` so feature groups can be
composed (F23) with ``DataFrame.withColumns`` and projected (F24) by schema.
All of them are narrow projections: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms as T
from .text import (SPACE, WORD_CHAR, _c, contains_any, count_terms, distinct_present, first_position,
                   safe_div, sentences, whitespace_words, words)

Features = dict[str, Column]

# FIXED VALUES: the number patterns (white space in its Unicode sense).
_S = SPACE
PERCENT_RE = rf"(\d+(?:[.,]\d+)?)(?:{_S}*)?%"
COARSE_PERCENT_RE = r"(\d+(?:,\d+)?%)|(\d+(?:\.\d+)?%)"
COARSE_CURRENCY_RE = rf"(?i)R\${_S}*\d+(?:[,.]\d+)*|\${_S}*\d+(?:[,.]\d+)*|€{_S}*\d+(?:[,.]\d+)*"
CURRENCY_RE = (rf"(?i)R\${_S}*(\d+(?:[.,]\d+)?(?:{_S}*{WORD_CHAR}+)?)|(\d+(?:[.,]\d+)?(?:{_S}*{WORD_CHAR}+)?{_S}*reais)"
               rf"|(\${_S}*\d+(?:[.,]\d+)?)")
# The same matches for Java in fewer steps a character: no step back into a run of digits, which would
# fail again, and no start within one.
_PERCENT_JAVA = rf"(\d(?<!\d\d)\d*+(?:[.,]\d++)?+){_S}*+%"
# As many as CURRENCY_RE finds in a text without the word "reais": each match has one sign, before a number.
_CURRENCY_SIGN = rf"\${_S}*+\d"
NUMERIC_RE = rf"\b(\d+(?:[.,]\d+)?){_S}*(milhões|bilhões|mil|mi|bi)?\b"


def regexp_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def currency_count(text: Column) -> Column:
    """Matches of ``CURRENCY_RE``; its word form is only tried on texts that have the word."""
    return (F.when(F.contains(F.lower(text), F.lit("reais")), regexp_count(text, CURRENCY_RE))
            .when(F.contains(text, F.lit("$")), regexp_count(text, _CURRENCY_SIGN)).otherwise(F.lit(0).cast("bigint")))


# ---------------------------------------------------------------- F1-F3 coarse

def coarse_type_flags(text: str | Column) -> Features:
    """``is_relatorio / is_comunicado / is_guidance``."""
    t = _c(text)
    return {f"is_{k}": contains_any(t, v) for k, v in T.COARSE_TYPE_INDICATORS.items()}


def coarse_sentiment(text: str | Column) -> Features:
    """number of distinct coarse positive / negative terms present."""
    t = _c(text)
    return {"positive_count": distinct_present(t, T.COARSE_POSITIVE),
            "negative_count": distinct_present(t, T.COARSE_NEGATIVE)}


def coarse_impact(text: str | Column) -> Features:
    """percent literals and currency amounts (case-insensitive ``R$``)."""
    t = _c(text)
    return {"percentage_count": regexp_count(t, COARSE_PERCENT_RE),
            "currency_count": regexp_count(t, COARSE_CURRENCY_RE)}


# ---------------------------------------------------------------- F4-F6 type indicators

def type_indicators(text: str | Column, indicators: Mapping[str, list[str]] = T.TYPE_INDICATORS) -> Features:
    """F4 ``is_<type>``, F5 ``count_<type>``, F6 ``pos_<type>`` (null when absent)."""
    t = _c(text)
    out: Features = {}
    for name, terms in indicators.items():
        out[f"is_{name}"] = contains_any(t, terms)
        out[f"count_{name}"] = count_terms(t, terms)
        out[f"pos_{name}"] = F.when(F.length(t) > 0, first_position(t, terms) / F.length(t))
    return out


# ---------------------------------------------------------------- F7-F9 structure, entities, metadata

def with_structural(df: DataFrame, sentences_col: str, words_col: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """sentence count, mean / population variance / max words per sentence,
    word count and mean word length.

    Sentence lengths, their mean and the variance are projections of their own, so the
    variance's lambda reads a column; inlined, the mean would be summed per sentence.
    """
    lens = df.select(*keep, words_col, F.transform(sentences_col, lambda x: F.size(whitespace_words(x)).cast("double"))
                     .alias("_lens"))
    n = F.size("_lens").cast("bigint")
    mean = lens.select(*keep, words_col, "_lens", F.when(n > 0, F.aggregate(
        "_lens", F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0).alias("_mean"))
    var = F.aggregate("_lens", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    nw = F.size(words_col).cast("bigint")
    wl = F.aggregate(words_col, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return mean.select(*keep, n.alias("num_sentences"), F.col("_mean").alias("avg_sentence_length"),
                       F.when(n > 1, var).otherwise(0.0).alias("var_sentence_length"),
                       F.coalesce(F.array_max("_lens"), F.lit(0.0)).alias("max_sentence_length"),
                       nw.alias("num_words"), F.when(nw > 0, wl / nw).otherwise(0.0).alias("avg_word_length"))


ENTITY_TYPES = ("ORG", "MONEY", "PERCENT", "CARDINAL", "DATE")
FINANCIAL_ENTITY_TYPES = ("ORG", "MONEY", "PERCENT")


def entity_counts(entities_col: str | Column, words_col: str | Column) -> Features:
    """F8: entity count per type, total, and financial-entity density per word.

    ``entities_col`` is ``ARRAY<STRUCT<ent_text, ent_type>>`` from T8.
    """
    e = _c(entities_col)
    types = e["ent_type"]

    def of_type(k: str) -> Column:
        return (F.size(types) - F.size(F.array_remove(types, k))).cast("bigint")
    out: Features = {f"entity_{k}_count": of_type(k) for k in ENTITY_TYPES}
    out["total_entities"] = F.size(e).cast("bigint")
    first, *rest = [of_type(k) for k in FINANCIAL_ENTITY_TYPES]
    fin = first
    for c in rest:
        fin = fin + c
    out["financial_entity_density"] = safe_div(fin, F.size(_c(words_col)))
    return out


SOURCE_KEYS = ("site", "pdf", "email", "internal", "external", "report")


def metadata_flags(metadata_col: str | Column) -> Features:
    """flags from the metadata map (source keys, explicit type, date)."""
    m = _c(metadata_col)
    src = F.lower(F.element_at(m, F.lit("source")))
    dtype = F.lower(F.element_at(m, F.lit("document_type")))
    has_src = F.coalesce(F.map_contains_key(m, F.lit("source")), F.lit(False))
    has_type = F.coalesce(F.map_contains_key(m, F.lit("document_type")), F.lit(False))
    out: Features = {"has_source": has_src}
    for k in SOURCE_KEYS:
        out[f"source_contains_{k}"] = has_src & F.coalesce(F.contains(src, F.lit(k)), F.lit(False))
    out["has_doc_type"] = has_type
    for k in T.TYPE_INDICATORS:
        out[f"metadata_type_{k}"] = has_type & F.coalesce(F.contains(dtype, F.lit(k)), F.lit(False))
    out["has_date"] = F.coalesce(F.map_contains_key(m, F.lit("date")), F.lit(False))
    return out


# ---------------------------------------------------------------- F10-F13 sentiment

def lexicon_features(text: str | Column, lexicon: Mapping[str, list[str]] = T.DEFAULT_LEXICON) -> Features:
    """``<category>_terms_count`` and ``_density`` (0 when no words)."""
    t = _c(text)
    nw = F.size(whitespace_words(t))
    out: Features = {}
    for cat, terms in lexicon.items():
        cnt = count_terms(t, terms)
        out[f"{cat}_terms_count"] = cnt
        out[f"{cat}_terms_density"] = safe_div(cnt, nw)
    return out


def with_lexicon_features(df: DataFrame, text_col: str, lexicon: Mapping[str, list[str]] = T.DEFAULT_LEXICON,
                          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """F10 from one term scan (same values as ``lexicon_features``)."""
    from .scan import term_scan
    scanned = term_scan(df.select(*keep, text_col), text_col, dict(lexicon))
    out: Features = {}
    for cat in lexicon:
        cnt = F.col(f"_scan.{cat}_count")
        out[f"{cat}_terms_count"] = cnt
        out[f"{cat}_terms_density"] = safe_div(cnt, F.col("_scan.n_words"))
    return scanned.select(*keep, *[c.alias(k) for k, c in out.items()])


def modifier_counts(text: str | Column) -> Features:
    """negation, intensifier, diminisher occurrences."""
    t = _c(text)
    return {"negation_count": count_terms(t, T.NEGATION_TERMS),
            "intensifier_count": count_terms(t, T.INTENSIFIERS),
            "diminisher_count": count_terms(t, T.DIMINISHERS)}


def negation_pattern(term: str) -> str:
    return rf"{term}{SPACE}+({WORD_CHAR}+{SPACE}+){{0,5}}({WORD_CHAR}+)"


def negation_patterns(text: str | Column) -> Features:
    """matches of ``<neg>\\s+(\\w+\\s+){0,5}(\\w+)`` summed over negation terms."""
    t = _c(text)
    total = F.lit(0).cast("bigint")
    for term in T.NEGATION_TERMS:
        total = total + F.when(F.contains(t, F.lit(term)), regexp_count(t, negation_pattern(term))).otherwise(F.lit(0).cast("bigint"))
    return {"negation_patterns_count": total}


def tense(text: str | Column) -> Features:
    """future / past counts and ratio (+inf when only future, 1.0 when neither)."""
    t = _c(text)
    fut = count_terms(t, T.FUTURE_INDICATORS)
    past = count_terms(t, T.PAST_INDICATORS)
    ratio = (F.when(past > 0, fut / past).when(fut > 0, F.lit(float("inf"))).otherwise(1.0))
    return {"future_orientation_count": fut, "past_orientation_count": past, "temporal_ratio": ratio}


# ---------------------------------------------------------------- F14-F17 numbers

def percentages(text: str | Column) -> Column:
    """Percent literals as ARRAY<DOUBLE> (comma decimal mark accepted)."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(_PERCENT_JAVA), 1),
                       lambda p: F.replace(p, F.lit(","), F.lit(".")).cast("double"))


def numeric_features(text: str | Column, high: float = 15.0, medium: float = 5.0) -> Features:
    """Percentage statistics and buckets, currency and numeric mentions, density."""
    t = _c(text)
    p = percentages(t)
    n = F.size(p).cast("bigint")
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    out: Features = {
        "percentage_count": n,
        "max_percentage": F.coalesce(F.array_max(p), F.lit(0.0)),
        "min_percentage": F.coalesce(F.array_min(p), F.lit(0.0)),
        "avg_percentage": F.when(n > 0, s / n).otherwise(0.0),
        "sum_percentage": s,
        "high_percentage_count": F.size(F.filter(p, lambda x: x >= high)).cast("bigint"),
        "medium_percentage_count": F.size(F.filter(p, lambda x: (x >= medium) & (x < high))).cast("bigint"),
        "low_percentage_count": F.size(F.filter(p, lambda x: x < medium)).cast("bigint"),
        "currency_count": currency_count(t),
        "numeric_value_count": regexp_count(t, NUMERIC_RE),
    }
    nw = F.size(whitespace_words(t))
    out["numerical_density"] = safe_div(out["percentage_count"] + out["currency_count"]
                                        + out["numeric_value_count"], nw)
    return out


# ---------------------------------------------------------------- F18-F22 impact

def impact_terms(text: str | Column, impact: Mapping[str, list[str]] = T.IMPACT_TERMS) -> Features:
    """F18 counts / densities per level, F19 ratios (denominator 0 -> high count)."""
    t = _c(text)
    nw = F.size(whitespace_words(t))
    out: Features = {}
    for level, lst in impact.items():
        cnt = count_terms(t, lst)
        out[f"{level}_count"] = cnt
        out[f"{level}_density"] = safe_div(cnt, nw)
    h, m, lo = out["high_impact_count"], out["medium_impact_count"], out["low_impact_count"]
    out["high_to_low_ratio"] = F.when(lo > 0, h / lo).otherwise(h.cast("double"))
    out["high_to_medium_ratio"] = F.when(m > 0, h / m).otherwise(h.cast("double"))
    return out


def time_horizon(text: str | Column) -> Features:
    """short / medium / long counts, predominant (ties short > medium > long)."""
    t = _c(text)
    s = count_terms(t, T.TIME_INDICATORS["short_term"])
    m = count_terms(t, T.TIME_INDICATORS["medium_term"])
    lg = count_terms(t, T.TIME_INDICATORS["long_term"])
    top = F.greatest(s, m, lg)
    pred = (F.when(top == 0, "none").when(s == top, "short").when(m == top, "medium").otherwise("long"))
    code = F.when(top == 0, 0).when(s == top, 1).when(m == top, 2).otherwise(3).cast("bigint")
    return {"short_term_count": s, "medium_term_count": m, "long_term_count": lg,
            "predominant_timeframe": pred, "timeframe_numeric": code}


def composite_impact(f: Mapping[str, Column], percentage_weight: float = 0.4,
                     impact_terms_weight: float = 0.4, temporal_weight: float = 0.2) -> Features:
    """F21 composite score and F22 volatility index from F14, F18 and F20 columns."""
    pct = F.least(F.lit(1.0), (f["high_percentage_count"] * 1.5 + f["medium_percentage_count"] * 1.0
                               + f["low_percentage_count"] * 0.5) / 10.0)
    terms = F.least(F.lit(1.0), (f["high_impact_density"] * 1.5 + f["medium_impact_density"] * 1.0
                                 + f["low_impact_density"] * 0.5) * 10.0)
    code = f["timeframe_numeric"]
    tscore = F.when(code > 0, (F.lit(4) - code) / 3.0).otherwise(0.5)
    h, lo = f["high_impact_count"], f["low_impact_count"]
    return {"percentage_impact_score": pct, "terms_impact_score": terms,
            "temporal_impact_score": tscore,
            "composite_impact_score": pct * percentage_weight + terms * impact_terms_weight
            + tscore * temporal_weight,
            "volatility_index": F.when((h > 0) & (lo > 0), (h * lo) / (h + lo)).otherwise(0.0)}


def impact_features(impact_text: str | Column) -> Features:
    """F14-F22 together (the impact model's feature set)."""
    out: Features = {}
    out.update(numeric_features(impact_text))
    out.update(impact_terms(impact_text))
    out.update(time_horizon(impact_text))
    out.update(composite_impact(out))
    return out


def with_impact_features(df: DataFrame, text_col: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """F14-F22 in two projections: raw counts first, then every derived value
    reads those columns (small generated methods, each count computed once)."""
    from .scan import term_scan
    t = F.col(text_col)
    p = percentages(t)
    scanned = term_scan(df.select(*keep, text_col), text_col, {**T.IMPACT_TERMS, **T.TIME_INDICATORS})
    stage1 = scanned.select(
        *keep, p.alias("_pc"), F.col("_scan.n_words").alias("_nw"),
        currency_count(t).alias("currency_count"),
        regexp_count(t, NUMERIC_RE).alias("numeric_value_count"),
        *[F.col(f"_scan.{lvl}_count").alias(f"{lvl}_count") for lvl in T.IMPACT_TERMS],
        *[F.col(f"_scan.{k}_count").alias(f"{k}_count") for k in T.TIME_INDICATORS])
    f: Features = {}
    f.update(numeric_features_from(F.col("_pc"), F.col("currency_count"), F.col("numeric_value_count"),
                                   F.col("_nw")))
    nw = F.col("_nw")
    for lvl in T.IMPACT_TERMS:
        f[f"{lvl}_count"] = F.col(f"{lvl}_count")
        f[f"{lvl}_density"] = safe_div(F.col(f"{lvl}_count"), nw)
    h, m, lo = F.col("high_impact_count"), F.col("medium_impact_count"), F.col("low_impact_count")
    f["high_to_low_ratio"] = F.when(lo > 0, h / lo).otherwise(h.cast("double"))
    f["high_to_medium_ratio"] = F.when(m > 0, h / m).otherwise(h.cast("double"))
    s_, m_, l_ = F.col("short_term_count"), F.col("medium_term_count"), F.col("long_term_count")
    top = F.greatest(s_, m_, l_)
    f["short_term_count"], f["medium_term_count"], f["long_term_count"] = s_, m_, l_
    f["predominant_timeframe"] = (F.when(top == 0, "none").when(s_ == top, "short").when(m_ == top, "medium")
                                  .otherwise("long"))
    f["timeframe_numeric"] = F.when(top == 0, 0).when(s_ == top, 1).when(m_ == top, 2).otherwise(3).cast("bigint")
    stage2 = stage1.select(*keep, *[c.alias(k) for k, c in f.items()])
    comp = composite_impact({k: F.col(k) for k in f})
    return stage2.select(*keep, *[F.col(k) for k in f], *[c.alias(k) for k, c in comp.items()])


def numeric_features_from(p: Column, currency: Column, numeric: Column, nw: Column,
                          high: float = 15.0, medium: float = 5.0) -> Features:
    n = F.size(p).cast("bigint")
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    out: Features = {
        "percentage_count": n,
        "max_percentage": F.coalesce(F.array_max(p), F.lit(0.0)),
        "min_percentage": F.coalesce(F.array_min(p), F.lit(0.0)),
        "avg_percentage": F.when(n > 0, s / n).otherwise(0.0),
        "sum_percentage": s,
        "high_percentage_count": F.size(F.filter(p, lambda x: x >= high)).cast("bigint"),
        "medium_percentage_count": F.size(F.filter(p, lambda x: (x >= medium) & (x < high))).cast("bigint"),
        "low_percentage_count": F.size(F.filter(p, lambda x: x < medium)).cast("bigint"),
        "currency_count": currency,
        "numeric_value_count": numeric,
    }
    out["numerical_density"] = safe_div(n + currency + numeric, nw)
    return out


def with_scanned_text_features(df: DataFrame, type_col: str, sent_col: str,
                               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """F4-F6 and F10-F13 from two one-pass term scans (same values as the
    expression builders ``type_indicators`` / ``sentiment_features``)."""
    from .scan import term_scan
    sent_dicts = {**{f"lex_{k}": v for k, v in T.DEFAULT_LEXICON.items()}, "negation": T.NEGATION_TERMS,
                  "intensifier": T.INTENSIFIERS, "diminisher": T.DIMINISHERS,
                  "future": T.FUTURE_INDICATORS, "past": T.PAST_INDICATORS}
    a = term_scan(df.select(*keep, type_col, sent_col), type_col, T.TYPE_INDICATORS, "_ts")
    b = term_scan(a, sent_col, sent_dicts, "_ss")
    tt, st = F.col(type_col), F.col(sent_col)
    nw = F.col("_ss.n_words")
    out: Features = {}
    for name in T.TYPE_INDICATORS:
        cnt, first = F.col(f"_ts.{name}_count"), F.col(f"_ts.{name}_first")
        out[f"is_{name}"] = cnt > 0
        out[f"count_{name}"] = cnt
        out[f"pos_{name}"] = F.when((F.length(tt) > 0) & (first >= 0), first / F.length(tt))
    for cat in T.DEFAULT_LEXICON:
        cnt = F.col(f"_ss.lex_{cat}_count")
        out[f"{cat}_terms_count"] = cnt
        out[f"{cat}_terms_density"] = safe_div(cnt, nw)
    for k in ("negation", "intensifier", "diminisher"):
        out[f"{k}_count"] = F.col(f"_ss.{k}_count")
    out.update(negation_patterns(st))
    fut, past = F.col("_ss.future_count"), F.col("_ss.past_count")
    out["future_orientation_count"] = fut
    out["past_orientation_count"] = past
    out["temporal_ratio"] = F.when(past > 0, fut / past).when(fut > 0, F.lit(float("inf"))).otherwise(1.0)
    return b.select(*keep, *[c.alias(k) for k, c in out.items()])


def sentiment_features(sent_text: str | Column) -> Features:
    """F10-F13 together (the sentiment model's extra features)."""
    out: Features = {}
    out.update(lexicon_features(sent_text))
    out.update(modifier_counts(sent_text))
    out.update(negation_patterns(sent_text))
    out.update(tense(sent_text))
    return out


# ---------------------------------------------------------------- F23-F24 composition

FeatureBuilder = Callable[[], Features]


def compose(*groups: Features, on_clash: str = "error") -> Features:
    """merge feature groups by name.

    ``on_clash='error'`` rejects duplicate names at plan-build time;
    ``'last'`` lets the later group win, as the reference's dict merge does.
    """
    out: Features = {}
    for g in groups:
        for k, v in g.items():
            if k in out and on_clash == "error":
                raise ValueError(f"feature {k!r} defined twice")
            out[k] = v
    return out


def safe_compose(*builders: FeatureBuilder) -> tuple[Features, list[str]]:
    """a builder that fails is skipped (reported), the others still apply."""
    out: Features = {}
    failed: list[str] = []
    for b in builders:
        try:
            out.update(b())
        except Exception as exc:  # noqa: BLE001 - reported to the caller
            failed.append(f"{getattr(b, '__name__', 'extractor')}: {exc}")
    return out, failed


def numeric_projection(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep numeric and boolean columns as DOUBLE (null -> 0.0); ``keep``
    columns (keys) pass through unchanged, everything else is dropped."""
    cols = [F.col(k) for k in keep]
    for f in df.schema.fields:
        if f.name in keep:
            continue
        tn = f.dataType.typeName()
        if tn in ("boolean", "byte", "short", "integer", "long", "float", "double") or tn.startswith("decimal"):
            cols.append(F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)).alias(f.name))
    return df.select(*cols)


# re-exported helpers used by feature callers
__all__ = [n for n in dir() if not n.startswith("_")] + ["sentences", "words"]
