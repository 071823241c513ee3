"""Entity extraction re-aimed as patterns plus a gazetteer.

MONEY, PERCENT, DATE and CARDINAL come from one leftmost-first alternation
(``regexp_extract_all``), each match typed by which alternative it fits; ORG
comes from a gazetteer of organisation words matched against the word tokens.
A model-based recogniser can replace this through the extractor registry (X8)
with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

MONEY_RE = r"(?:R\$|US\$|€|\$)\s*\d+(?:[.,]\d+)*(?:\s*(?:milhões|bilhões|mil|mi|bi))?"
DATE_RE = r"\d{1,2}/\d{1,2}/\d{4}"
PERCENT_RE = r"\d+(?:[.,]\d+)?\s*%"
CARDINAL_RE = r"\d+(?:[.,]\d+)*"
ENTITY_RE = "|".join([MONEY_RE, DATE_RE, PERCENT_RE, CARDINAL_RE])

DEFAULT_GAZETTEER = ("companhia", "empresa", "conselho", "administração")


def entity_type(m: Column) -> Column:
    """Of a match of ``ENTITY_RE``: only its date form holds a slash, only its percent form ends with the sign."""
    money = m.startswith("R$") | m.startswith("US$") | m.startswith("€") | m.startswith("$")
    return (F.when(money, "MONEY").when(m.contains("/"), "DATE").when(m.endswith("%"), "PERCENT").otherwise("CARDINAL"))


def entities(text: str | Column, words_col: str | Column,
             gazetteer: Sequence[str] = DEFAULT_GAZETTEER) -> Column:
    """ARRAY<STRUCT<ent_text STRING, ent_type STRING>> for one document."""
    pattern_ents = F.transform(F.regexp_extract_all(_c(text), F.lit(ENTITY_RE), 0),
                               lambda m: F.struct(m.alias("ent_text"), entity_type(m).alias("ent_type")))
    org = F.transform(F.filter(_c(words_col), lambda w: w.isin(*gazetteer)),
                      lambda w: F.struct(w.alias("ent_text"), F.lit("ORG").alias("ent_type")))
    return F.concat(pattern_ents, org)
