"""Query registry: every operator query and its DuckDB oracle SQL.

A query is ``(spark, sf_dir) -> DataFrame``; its oracle is an SQL string over
the provided tables (fixtures are inlined as CTEs).  Computed columns carry the
same aliases on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from ..functions.text import DIGIT, PUNCT, SPACE

QueryFn = Callable
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            # lineage cuts and stream state need the session's checkpoint folder
            from ..session import ensure_checkpoint_dir
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- SQL fragment helpers

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_count(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(term)}, ''))) // length({q(term)}))"


def sql_count_terms(text: str, terms) -> str:
    return "CAST((" + " + ".join(sql_count(text, t.lower()) for t in terms) + ") AS BIGINT)"


def sql_contains_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t.lower())})" for t in terms) + ")"


def sql_distinct_present(text: str, terms) -> str:
    return "CAST((" + " + ".join(f"CAST(contains({text}, {q(t.lower())}) AS BIGINT)" for t in terms) + ") AS BIGINT)"


def sql_norm(col: str, lowercase=True, punct=True, nums=False) -> str:
    c = f"coalesce(CAST({col} AS VARCHAR), '')"
    if lowercase:
        c = f"lower({c})"
    if punct:
        c = f"regexp_replace({c}, '{PUNCT}', ' ', 'g')"
    if nums:
        c = f"regexp_replace({c}, '{DIGIT}+', ' ', 'g')"
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def sql_norm_variant(col: str, variant: str) -> str:
    return {"type": sql_norm(col), "sentiment": sql_norm(col, nums=True),
            "impact": sql_norm(col, punct=False)}[variant]


def sql_ws_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> '')"


def sql_regexp_count(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {q(pattern)})) AS BIGINT)"


def sql_safe_div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"
