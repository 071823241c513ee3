"""Every registered query with an oracle, against DuckDB on sf0.001.

Runs a fast representative subset by default; FINLEX_ALL_ORACLES=1 runs all.
"""
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from finlex.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = ["S1_documents", "V2_V3_length_rules", "T1_normalize", "T9_derived_metadata", "F4_F6_type_indicators",
        "F10_lexicon_by_lang", "F14_F17_numeric", "F21_F22_composite", "X1_vocabulary", "L3_bernoulli_score",
        "L6_complement_score", "L9_gaussian_score", "A13_A15_posterior_partial", "A20_decision_summary",
        "M6_weighted_vote", "E7_impact_summary", "D2_business_dates", "T14_compute_once", "R2_R3_stream_statistics"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("FINLEX_ALL_ORACLES") else FAST


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(res.columns, drows)


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() > 0


def test_every_query_is_registered_with_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 120
