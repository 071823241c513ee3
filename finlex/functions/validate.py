"""Validation, sanitising and quarantine (V1-V9, V12) as Column expressions.

A row never raises: it carries ``error_code`` (null when valid) so a batch can
be split into a clean table and a quarantine table in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CONTROL_CHARS, _c

MIN_LENGTH = 1
MAX_LENGTH = 1_000_000
NESTED_LIMIT = 1000
NESTED_MARKER = "aninhamento_truncado"


def validate_text(col: str | Column, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH,
                  allow_empty: bool = False) -> tuple[Column, Column]:
    """V1-V3: returns ``(clean_text, error_code)``.

    Null -> ``NULL_TEXT`` unless empty input is allowed; non-strings are cast;
    too short -> ``TEXT_TOO_SHORT``; too long is truncated; control characters
    are removed after truncation.
    """
    raw = _c(col).cast("string")
    n = F.length(raw)
    err = (F.when(raw.isNull() & F.lit(not allow_empty), F.lit("NULL_TEXT"))
           .when(raw.isNotNull() & (n < min_length) & ~(F.lit(allow_empty) & (n == 0)),
                 F.lit("TEXT_TOO_SHORT")))
    base = F.when(raw.isNull(), F.lit("")).otherwise(raw)
    truncated = F.when(F.length(base) > max_length, F.substring(base, 1, max_length)).otherwise(base)
    clean = F.when(err.isNull(), F.regexp_replace(truncated, CONTROL_CHARS, ""))
    return clean, err


def truncation(col: str | Column, max_length: int = MAX_LENGTH) -> Column:
    """V2: ``TEXT_TRUNCATED`` for a text that the length rule cuts, else null."""
    return F.when(F.length(_c(col).cast("string")) > max_length, F.lit("TEXT_TRUNCATED"))


def sanitize_text(col: str | Column, max_length: int = MAX_LENGTH) -> Column:
    """V9: never fails; null -> '' else the cast, cleaned text."""
    raw = _c(col).cast("string")
    base = F.coalesce(raw, F.lit(""))
    truncated = F.when(F.length(base) > max_length, F.substring(base, 1, max_length)).otherwise(base)
    return F.regexp_replace(truncated, CONTROL_CHARS, "")


def parse_metadata(col: str | Column) -> tuple[Column, Column]:
    """V4: null -> {}; JSON object text -> MAP<STRING,STRING>; otherwise an error.

    Returns ``(metadata, error_code)``.  Non-string JSON values keep their JSON
    text (nested objects stay as JSON strings).
    """
    raw = _c(col)
    parsed = F.from_json(raw, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    ok = raw.isNull() | parsed.isNotNull()
    md = F.when(raw.isNull(), empty).otherwise(parsed)
    err = F.when(~ok, F.lit("INVALID_METADATA_JSON"))
    return md, err


def require_fields(md: Column, required: Sequence[str]) -> Column:
    """V5: ``MISSING_METADATA_FIELD`` when any required key is absent."""
    cond = F.lit(True)
    for f in required:
        cond = cond & F.map_contains_key(md, F.lit(f))
    return F.when(~cond, F.lit("MISSING_METADATA_FIELD"))


def restrict_fields(md: Column, allowed: Sequence[str] | None) -> Column:
    """V6: keep only allowed keys (no restriction when ``allowed`` is None)."""
    if allowed is None:
        return md
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    return F.map_filter(md, lambda k, v: F.array_contains(allowed_arr, k))


def clean_metadata_values(md: Column) -> Column:
    """V7: strip control characters; nested objects longer than 1,000 chars -> marker.

    Dates arrive as ISO text already (``from_json`` keeps them as strings).
    """
    def clean(k, v):
        nested = v.startswith("{") & (F.length(v) > NESTED_LIMIT)
        return F.when(nested, F.lit(NESTED_MARKER)).otherwise(F.regexp_replace(v, CONTROL_CHARS, ""))
    return F.transform_values(md, clean)


def validate_documents(df: DataFrame, text_col: str = "text", metadata_col: str | None = None,
                       required: Sequence[str] = (), allowed: Sequence[str] | None = None,
                       min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH,
                       allow_empty: bool = False) -> DataFrame:
    """V1-V7 over a batch: adds ``clean_text``, ``metadata_clean``, ``error_code`` and
    ``notice_code`` (``TEXT_TRUNCATED`` where the length rule cut a valid text)."""
    clean, terr = validate_text(text_col, min_length, max_length, allow_empty)
    out = df.withColumn("clean_text", clean).withColumn("notice_code", F.when(terr.isNull(), truncation(text_col, max_length)))
    if metadata_col is None:
        return out.withColumn("error_code", terr)
    mtype = df.schema[metadata_col].dataType.typeName()
    if mtype == "map":
        md, merr = F.col(metadata_col).cast("map<string,string>"), F.lit(None).cast("string")
        md = F.coalesce(md, F.create_map().cast("map<string,string>"))
    else:
        md, merr = parse_metadata(metadata_col)
    rerr = require_fields(md, required) if required else F.lit(None).cast("string")
    md = clean_metadata_values(restrict_fields(md, allowed))
    return (out.withColumn("metadata_clean", F.when(merr.isNull(), md))
            .withColumn("error_code", F.coalesce(terr, merr, rerr)))


def validate_batch(df: DataFrame, text_col: str = "text", metadata_col: str | None = None,
                   max_batch_size: int | None = None, order_col: str | None = None, **kw) -> DataFrame:
    """V8: invalid text -> '', invalid metadata -> {}; optional batch-size cap.

    ``max_batch_size`` is the reference's explicit input-size limit (a feature
    of the operator).  The rows beyond it, in ``order_col`` order, stay in the
    result with ``error_code`` ``BATCH_LIMIT``, so a caller sees what was refused.
    """
    if max_batch_size is not None and order_col is None:
        raise ValueError("a batch limit needs an order, or it would refuse arbitrary rows")
    v = validate_documents(df, text_col, metadata_col, **kw)
    empty = F.create_map().cast("map<string,string>")
    v = v.withColumn("clean_text", F.coalesce(F.col("clean_text"), F.lit("")))
    if metadata_col is not None:
        v = v.withColumn("metadata_clean", F.coalesce(F.col("metadata_clean"), empty))
    if max_batch_size is not None:
        first = v.select(order_col).orderBy(order_col).limit(max_batch_size + 1)
        edge = first.agg(F.count(F.lit(1)).alias("n"), F.max(order_col).alias("edge")).first()
        if edge["n"] > max_batch_size:
            v = v.withColumn("error_code", F.when(F.col(order_col) >= F.lit(edge["edge"]), F.lit("BATCH_LIMIT"))
                             .otherwise(F.col("error_code")))
    return v


def quarantine_split(df: DataFrame, error_col: str = "error_code") -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows)."""
    return df.filter(F.col(error_col).isNull()), df.filter(F.col(error_col).isNotNull())
