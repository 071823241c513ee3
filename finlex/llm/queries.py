"""The registered queries of this subpackage and their oracle SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import (
    alignment,
    html_render,
    line_dedup,
    packing,
    pii_crf,
    piece_table,
    robust_outliers,
    shards,
    simhash_pigeonring,
    warc,
    wavelet,
    wordpiece_count,
    wu_manber,
)
from .common import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hx FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hx, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest
      FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@register("op1_warc_chunks", OP1_SQL)
def op1(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


@register("op2_skip_chain_crf")
def op2(spark, sf_dir):
    return pii_crf.report(table(spark, sf_dir, "documents"))


@register("op3_wavelet_matrix")
def op3(spark, sf_dir):
    return wavelet.report(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@register("op4_conflict_best_fit")
def op4(spark, sf_dir):
    return packing.report(table(spark, sf_dir, "documents"),
                          pieces=wordpiece_count.vocabulary(tokenizer_file("piece_bpe_32k.model")))


@register("op5_robust_outliers")
def op5(spark, sf_dir):
    return robust_outliers.report(table(spark, sf_dir, "documents"))


@register("op6_html_render")
def op6(spark, sf_dir):
    return html_render.report(table(spark, sf_dir, "pages"))


@register("op7_simhash_pigeonring")
def op7(spark, sf_dir):
    return simhash_pigeonring.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
    SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
win AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM pat))),
occ AS (SELECT doc_id, i, win.m, item_id FROM win JOIN pat USING (m, p)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op8_wu_manber", OP8_SQL)
def op8(spark, sf_dir):
    return wu_manber.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_wordpiece_count")
def op9(spark, sf_dir):
    return wordpiece_count.counted(table(spark, sf_dir, "documents"),
                                   wordpiece_count.vocabulary(tokenizer_file("piece_bpe_32k.model")))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS toks FROM documents),
w AS (SELECT doc_id, i, toks[i] AS tok FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM t)),
x AS (SELECT doc_id, i, regexp_extract(tok, '[^\x20\x09-\x0D]+$') AS raw,
             CASE WHEN i = 1 THEN 0 ELSE contains(tok, chr(10))::INT END AS brk,
             sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM w),
y AS (SELECT doc_id, i, e, e - length(raw) AS s, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lw,
             sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM x),
m AS (SELECT doc_id, min(substr(md5(lw), 1, 16) || lpad(i::VARCHAR, 12, '0'))
                       OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS least,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS width FROM y),
p AS (SELECT DISTINCT doc_id, substr(least, 17)::BIGINT AS i FROM m WHERE width = 15),
l AS (SELECT doc_id, list(lw ORDER BY i) AS ws, list(s ORDER BY i) AS ss, list(e ORDER BY i) AS es FROM y GROUP BY doc_id),
u AS (SELECT doc_id, ss[i] AS s, es[i + 35] AS e, array_to_string(ws[i:i + 35], ' ') AS unit FROM p JOIN l USING (doc_id) WHERE i + 35 <= len(ws)
      UNION SELECT doc_id, min(s), max(e), string_agg(lw, ' ' ORDER BY i) FROM y GROUP BY doc_id, line HAVING count(*) >= 5),
f AS (SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(s) OVER o AS kept_start, first_value(e) OVER o AS kept_end
      FROM u WINDOW o AS (PARTITION BY unit ORDER BY doc_id, s))
SELECT doc_id, s::BIGINT AS "start", e::BIGINT AS "end", kept_doc_id, kept_start::BIGINT AS kept_start FROM f
WHERE doc_id <> kept_doc_id OR s >= kept_end
"""


@register("op10_line_dedup", OP10_SQL)
def op10(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(hx, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(hx, 9, 8))::BIGINT % (n + 1) AS c2,
             ('0x' || substr(hx, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(hx, 25, 8))::BIGINT % 100 AS r4 FROM d),
f AS (SELECT *, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain'
                  WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


@register("op11_piece_table", OP11_SQL)
def op11(spark, sf_dir):
    return piece_table.report(table(spark, sf_dir, "documents"))


@register("op12_arrow_alignment")
def op12(spark, sf_dir):
    return alignment.report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@register("op13_external_shuffle")
def op13(spark, sf_dir):
    return shards.report(table(spark, sf_dir, "documents"))
