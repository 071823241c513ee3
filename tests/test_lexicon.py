"""Lexicons stored one row a term, numbered without a window over a category."""
import random

import pytest
from pyspark.sql import functions as F

from finlex.functions import terms as T
from finlex.sources import lexicon as LX


def test_ordinals_follow_the_order_across_range_partitions(spark):
    rng = random.Random(3)
    rows = [("positive" if rng.random() < 0.9 else "neutral", f"t{k:05d}") for k in range(3000)]
    df = spark.createDataFrame(rows, "category string, term string").repartition(7)
    want = {(c, t): i for c in ("positive", "neutral") for i, t in enumerate(sorted(t for d, t in rows if d == c))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions, also for few rows
    try:
        out = LX.numbered(df, "category", "term")
        plan = out._jdf.queryExecution().toString()
        got = {(r.category, r.term): r.ord for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and len(got) == 3000 and "_part" in plan
    assert LX.numbered(df.limit(0), "category", "term").count() == 0


@pytest.mark.parametrize("fmt", ["json", "jsonl", "csv", "parquet"])
def test_round_trip_keeps_terms_and_order(spark, tmp_path, fmt):
    rows = [("x", c, f"{t} {k}", i * 40 + k) for c in LX.CATEGORIES for i, t in enumerate(T.DEFAULT_LEXICON[c]) for k in range(40)]
    lex = spark.createDataFrame(rows, LX.LEXICON_SCHEMA).repartition(5)
    LX.save_lexicon(lex, f"{tmp_path}/{fmt}", fmt)
    got = {(r.category, r.term, r.ord) for r in LX.load_lexicon(spark, f"{tmp_path}/{fmt}", "y").collect()}
    assert got == {r[1:] for r in rows}


def test_incomplete_or_oversized_lexicons_are_refused(spark, tmp_path, monkeypatch):
    lex = LX.default_lexicon(spark)
    LX.save_lexicon(lex.filter("category <> 'neutral'"), f"{tmp_path}/part.parquet", "parquet")
    assert LX.load_lexicon(spark, f"{tmp_path}/part.parquet") is None
    monkeypatch.setattr(LX, "LEXICON_BYTES", 100)
    with pytest.raises(ValueError, match="jsonl or parquet"):
        LX.save_lexicon(lex, f"{tmp_path}/big", "json")
    with pytest.raises(ValueError, match="unknown"):
        LX.save_lexicon(lex, f"{tmp_path}/odd", "xml")


def test_added_terms_continue_the_numbers_of_their_category(spark):
    lex = LX.default_lexicon(spark)
    new = spark.createDataFrame([("positive", "zz"), ("positive", "aa"), ("positive", "aa"), ("unknown", "q"),
                                 ("neutral", T.DEFAULT_LEXICON["neutral"][0])], "category string, term string")
    out = LX.extend_lexicon(lex, new)
    n = len(T.DEFAULT_LEXICON["positive"])
    extra = {(r.category, r.term, r.ord) for r in out.filter(F.col("term").isin("zz", "aa", "q")).collect()}
    assert extra == {("positive", "aa", n), ("positive", "zz", n + 1)} and out.count() == lex.count() + 2
