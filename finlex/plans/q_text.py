"""Queries for sources, validation and text preprocessing (S1, S2, V*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import validate as V
from ..sources import tables as S
from .registry import register, sql_norm, sql_norm_variant, sql_ws_words

NGRAM_SQL = """list_concat(
  list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i], ' ')),
  list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')),
  list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))"""
WORDS_SQL = "list_filter(string_split({n}, ' '), lambda x: x <> '')"
SENT_SQL = ("list_filter(string_split(regexp_replace(trim(coalesce({t}, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'),"
            " chr(1)), lambda s: s <> '')")


@register("S1_documents", """
SELECT doc_id, lang AS md_lang, source AS md_source, CAST(length(text) AS BIGINT) AS text_length
FROM documents""")
def s1_documents(spark, sf):
    d = S.documents(spark, sf, with_metadata=True)
    return d.select("doc_id", F.col("metadata")["lang"].alias("md_lang"),
                    F.col("metadata")["source"].alias("md_source"),
                    F.length("text").cast("bigint").alias("text_length"))


@register("S2_training_source", """
SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS label, CAST(length(d.text) AS BIGINT) AS text_length
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def s2_training(spark, sf):
    return S.labelled_documents(spark, sf).select(
        "doc_id", "label", F.length("text").cast("bigint").alias("text_length"))


@register("V1_null_and_cast", """
SELECT d.doc_id,
  CASE WHEN l.quality IS NULL THEN 'NULL_TEXT' END AS error_code,
  CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality AS VARCHAR) END AS clean_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def v1_null(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id")
    lab = S.table(spark, sf, "labels", "doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    clean, err = V.validate_text(F.col("quality"))
    return j.select("doc_id", err.alias("error_code"), clean.alias("clean_text"))


V2_MIN, V2_MAX = 200, 5000


@register("V2_V3_length_rules", f"""
SELECT doc_id,
  CASE WHEN length(text) < {V2_MIN} THEN 'TEXT_TOO_SHORT' END AS error_code,
  CASE WHEN length(text) >= {V2_MIN} THEN CAST(length(regexp_replace(substr(text, 1, {V2_MAX}),
       '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS BIGINT) END AS clean_length,
  CASE WHEN length(text) >= {V2_MIN} THEN md5(regexp_replace(substr(text, 1, {V2_MAX}),
       '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) END AS clean_md5,
  CASE WHEN length(text) > {V2_MAX} THEN 'TEXT_TRUNCATED' END AS notice_code
FROM documents""")
def v2_length(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    clean, err = V.validate_text("text", min_length=V2_MIN, max_length=V2_MAX)
    return d.select("doc_id", err.alias("error_code"), F.length(clean).cast("bigint").alias("clean_length"),
                    F.md5(clean).alias("clean_md5"), V.truncation("text", V2_MAX).alias("notice_code"))


@register("V3_control_chars", """
SELECT page_id, CAST(length(html) - length(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))
  AS BIGINT) AS removed, md5(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS clean_md5
FROM pages""")
def v3_control(spark, sf):
    p = S.table(spark, sf, "pages", "page_id", "html")
    c = TX.remove_control_chars("html")
    return p.select("page_id", (F.length("html") - F.length(c)).cast("bigint").alias("removed"),
                    F.md5(c).alias("clean_md5"))


def _event_metadata(spark, sf):
    e = S.table(spark, sf, "events", "event_id", "ts", "event_type", "props")
    md, err = V.parse_metadata("props")
    return e, md, err


@register("V4_metadata_parse", """
SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS md_keys,
  json_extract_string(props, '$.k') AS md_k, CAST(NULL AS VARCHAR) AS error_code
FROM events""")
def v4_parse(spark, sf):
    e, md, err = _event_metadata(spark, sf)
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(md)), ",").alias("md_keys"),
                    md["k"].alias("md_k"), err.alias("error_code"))


@register("V5_required_fields", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN json_extract(props, '$.k') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_k,
  CAST(sum(CASE WHEN json_extract(props, '$.k') IS NULL OR event_type <> 'click' THEN 1 ELSE 0 END) AS BIGINT)
    AS missing_k_or_click
FROM events GROUP BY event_type""")
def v5_required(spark, sf):
    e, md, _ = _event_metadata(spark, sf)
    md2 = F.when(F.col("event_type") == "click", F.map_concat(md, F.create_map(F.lit("click"), F.lit("1")))) \
        .otherwise(md)
    return (e.select("event_type", V.require_fields(md, ["k"]).alias("e1"),
                     V.require_fields(md2, ["k", "click"]).alias("e2"))
            .groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.count("e1").alias("missing_k"),
                 F.count("e2").alias("missing_k_or_click")))


@register("V6_V7_allowed_and_clean", """
SELECT event_id, 'event_type,ts' AS md_keys, event_type AS md_event_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS md_ts
FROM events""")
def v6_v7(spark, sf):
    e, md, _ = _event_metadata(spark, sf)
    full = F.map_concat(md, F.create_map(F.lit("event_type"), F.col("event_type"),
                                         F.lit("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    kept = V.clean_metadata_values(V.restrict_fields(full, ["event_type", "ts"]))
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("md_keys"),
                    kept["event_type"].alias("md_event_type"), kept["ts"].alias("md_ts"))


@register("V8_V9_batch_sanitize", """
SELECT d.doc_id, coalesce(CAST(l.toxic AS VARCHAR), '') AS clean_text,
  CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS has_label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def v8_batch(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id")
    lab = S.table(spark, sf, "labels", "doc_id", "toxic").withColumn("has_label", F.lit(1))
    j = d.join(lab, "doc_id", "left")
    v = V.validate_batch(j.select("doc_id", F.col("toxic").alias("t"), "has_label"), "t")
    return v.select("doc_id", V.sanitize_text("clean_text").alias("clean_text"),
                    F.coalesce("has_label", F.lit(0)).alias("has_label"))


@register("V12_quarantine_split", """
SELECT lang, CASE WHEN length(text) < 300 THEN 'quarantine' ELSE 'clean' END AS status,
  CAST(count(*) AS BIGINT) AS n
FROM documents GROUP BY 1, 2""")
def v12_quarantine(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text", "lang")
    v = V.validate_documents(d, min_length=300)
    clean, bad = V.quarantine_split(v)
    return (clean.select("lang", F.lit("clean").alias("status"))
            .unionByName(bad.select("lang", F.lit("quarantine").alias("status")))
            .groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n")))


@register("T1_normalize", f"""
SELECT doc_id, {sql_norm('text')} AS norm FROM documents""")
def t1_normalize(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", TX.normalize("text").alias("norm"))


@register("T2_variants", f"""
SELECT doc_id, md5({sql_norm_variant('text', 'type')}) AS type_md5,
  md5({sql_norm_variant('text', 'sentiment')}) AS sentiment_md5,
  md5({sql_norm_variant('text', 'impact')}) AS impact_md5,
  CAST(length({sql_norm_variant('text', 'sentiment')}) AS BIGINT) AS sentiment_len
FROM documents""")
def t2_variants(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(TX.normalize_variant("text", "type")).alias("type_md5"),
                    F.md5(TX.normalize_variant("text", "sentiment")).alias("sentiment_md5"),
                    F.md5(TX.normalize_variant("text", "impact")).alias("impact_md5"),
                    F.length(TX.normalize_variant("text", "sentiment")).cast("bigint").alias("sentiment_len"))


@register("T4_words", f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS word_count, md5(array_to_string(w, '|')) AS words_md5
FROM (SELECT doc_id, {WORDS_SQL.format(n=sql_norm('text'))} AS w FROM documents)""")
def t4_words(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    w = TX.words(TX.normalize("text"))
    return d.select("doc_id", F.size(w).cast("bigint").alias("word_count"),
                    F.md5(F.array_join(w, "|")).alias("words_md5"))


@register("T5_sentences", f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentence_count, md5(array_to_string(s, '|')) AS sentences_md5
FROM (SELECT doc_id, {SENT_SQL.format(t='text')} AS s FROM documents)""")
def t5_sentences(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    s = TX.sentences("text")
    return d.select("doc_id", F.size(s).cast("bigint").alias("sentence_count"),
                    F.md5(F.array_join(s, "|")).alias("sentences_md5"))


@register("T6_ngrams", f"""
SELECT doc_id, CAST(len(g) AS BIGINT) AS ngram_count, md5(array_to_string(g, '|')) AS ngrams_md5
FROM (SELECT doc_id, {NGRAM_SQL} AS g
      FROM (SELECT doc_id, {WORDS_SQL.format(n=sql_norm('text'))} AS w FROM documents))""")
def t6_ngrams(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    # words materialised first: n-gram lambdas then read a column, not the whole
    # normalisation expression once per n-gram
    w = d.select("doc_id", TX.words(TX.normalize("text")).alias("w"))
    g = TX.ngrams("w", 1, 3)
    return w.select("doc_id", F.size(g).cast("bigint").alias("ngram_count"),
                    F.md5(F.array_join(g, "|")).alias("ngrams_md5"))


@register("T7_fallback_tokens", f"""
SELECT conv_id, turn, CAST(len({sql_ws_words('text')}) AS BIGINT) AS word_count,
  CAST(1 AS BIGINT) AS sentence_count, 'tokenizer_fallback' AS warning
FROM conversations""")
def t7_fallback(spark, sf):
    c = S.table(spark, sf, "conversations", "conv_id", "turn", "text")
    tok = TX.fallback_tokens("text")
    return c.select("conv_id", "turn", F.size(tok["words"]).cast("bigint").alias("word_count"),
                    F.size(tok["sentences"]).cast("bigint").alias("sentence_count"),
                    F.lit("tokenizer_fallback").alias("warning"))


@register("T9_derived_metadata", f"""
SELECT doc_id, CAST(length(n) AS BIGINT) AS text_length, CAST(len(w) AS BIGINT) AS word_count,
  CAST(len(s) AS BIGINT) AS sentence_count,
  CASE WHEN len(w) > 0 AND len(s) > 0 THEN round(len(w) / len(s), 6) END AS complexity_score,
  CASE WHEN len(w) > 0 AND len(s) > 0 THEN
    CASE WHEN len(w) / len(s) > 25 THEN 'alta' WHEN len(w) / len(s) > 15 THEN 'média' ELSE 'baixa' END
  END AS complexity_level
FROM (SELECT doc_id, n, {WORDS_SQL.format(n='n')} AS w, {SENT_SQL.format(t='text')} AS s
      FROM (SELECT doc_id, text, {sql_norm('text')} AS n FROM documents))""")
def t9_derived(spark, sf):
    d = S.table(spark, sf, "documents", "doc_id", "text")
    # staged, so that each text is normalised and split once
    n = d.select("doc_id", "text", TX.normalize("text").alias("n"))
    w = n.select("doc_id", "n", TX.words("n").alias("w"), TX.sentences("text").alias("s"))
    m = TX.derived_metadata("n", "w", "s")
    return w.select("doc_id", m["text_length"].alias("text_length"), m["word_count"].alias("word_count"),
                    m["sentence_count"].alias("sentence_count"),
                    F.round(m["complexity_score"], 6).alias("complexity_score"),
                    m["complexity_level"].alias("complexity_level"))
