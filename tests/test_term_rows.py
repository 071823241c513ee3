"""Sums over documents' packed rows: against the long form, without a row a term."""
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finlex.functions import grams as GR
from finlex.operators import evaluate as EV
from finlex.operators import naive_bayes as NB
from finlex.operators import tuning as TU
from finlex.operators import vocab as VO

CFG = VO.VocabConfig(1, 2, 1, 60)


def _docs(spark, twice=False):
    rng = random.Random(7)
    words = ["aa", "bb", "cc", "dd", "é", "éé", "zz"]
    rows = [(k, rng.choice(["p", "q", "p", None]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 9, 600])))) for k in range(60)]
    rows = [*rows, *[(k, "q", "aa bb") for k in range(0, 60, 7)]] if twice else rows
    return spark.createDataFrame(rows, "doc_id LONG, label STRING, t STRING").repartition(3)


def _vectors(spark, twice=False, keep=("label",), extra=None):
    docs = _docs(spark, twice)
    vocab = VO.fit_vocabulary(docs, "t", CFG).checkpoint()
    return VO.vectorize(docs.select("*", *(extra or [])), "t", vocab, CFG, keep), vocab


def test_packed_rows_come_back():
    rng = np.random.default_rng(1)
    for terms in (50, 70_000):
        sizes = rng.integers(0, 9, 40)
        row = np.repeat(np.arange(40), sizes)
        idx = rng.integers(0, terms, len(row))
        n = rng.choice([1, 2, 255, 256, 70_000], len(row))
        cols = GR._packed(row, idx, n, 40, terms)
        for lo, hi in ((0, 40), (7, 31), (5, 5)):
            at, i, k = GR._unpacked([c.slice(lo, hi - lo) for c in cols], terms)
            mine = (row >= lo) & (row < hi)
            assert at.tolist() == [0, *np.cumsum(sizes[lo:hi])] and (i == idx[mine]).all() and (k == n[mine]).all()
        assert cols[2].to_pylist().count(b"") < 40 and pa.types.is_binary(cols[0].type)


def _same(a, b, key):
    a, b = ({tuple(r[k] for k in key): r for r in d.collect()} for d in (a, b))
    assert a.keys() == b.keys()
    for k, r in a.items():
        for name, v in r.asDict().items():
            assert b[k][name] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v)


def test_idf_fits_and_scores_equal_the_long_form(spark):
    vec, vocab = _vectors(spark)
    docs = vec.given.select("doc_id", "label")
    known, n = docs.filter("label IS NOT NULL"), docs.count()
    idf = VO.idf_table(vec, n, vocab).checkpoint()
    _same(idf, VO.idf_table(vec.long(), n, vocab), ("term",))
    rows, long = VO.tfidf_rows(vec, idf), VO.tfidf(vec, idf)
    assert isinstance(rows, VO.TermRows)
    _same(rows.label_sums(), long.groupBy("label", "term").agg(F.sum("w").alias("x")), ("label", "term"))
    _same(VO.weight_profile(rows), VO.weight_profile(long), ("doc_id",))
    a, b = (NB.complement_fit(w, known, vocab) for w in (rows, long))
    _same(a.weights, b.weights, ("label", "term"))
    got, want = (NB.complement_score(a, w, docs.select("doc_id")).drop("probabilities") for w in (rows, long))
    _same(got, want, ("doc_id",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Generate", "Aggregate", "Join"))
    a, b = (NB.bernoulli_fit(w, known, vocab) for w in (vec.present(), vec.long()))
    _same(a.theta, b.theta, ("label", "term"))
    _same(*(NB.bernoulli_score(a, w, docs.select("doc_id")).drop("probabilities") for w in (vec.present(), vec.long())), ("doc_id",))


def test_a_large_model_is_joined(spark, monkeypatch):
    vec, vocab = _vectors(spark)
    docs = vec.given.select("doc_id", "label")
    rows = VO.tfidf_rows(vec, VO.idf_table(vec, 60, vocab))
    m = NB.complement_fit(rows, docs.filter("label IS NOT NULL"), vocab)
    want = NB.complement_score(m, rows, docs.select("doc_id")).drop("probabilities").collect()
    monkeypatch.setattr(NB, "BROADCAST_WEIGHTS", 1)
    got = {r.doc_id: r for r in NB.complement_score(m, rows, docs.select("doc_id")).collect()}
    assert len(got) == 60 and all(math.isclose(got[r.doc_id].confidence, r.confidence, rel_tol=1e-9) for r in want)


def test_sums_are_handed_on_in_between(spark, monkeypatch):
    vec, vocab = _vectors(spark)
    rows = VO.tfidf_rows(vec, VO.idf_table(vec, 60, vocab))
    want = rows.label_sums().collect()
    monkeypatch.setattr(GR, "SUMS_HELD", 1)
    _same(rows.label_sums(), spark.createDataFrame(want), ("label", "term"))


def test_repeated_documents_take_the_long_form(spark):
    vec, vocab = _vectors(spark, twice=True)
    assert vec.repeated and not isinstance(vec.present(), VO.TermRows)
    idf = VO.idf_table(vec, 60, vocab)
    assert not isinstance(VO.tfidf_rows(vec, idf), VO.TermRows)
    _same(idf, VO.idf_table(vec.long(), 60, vocab), ("term",))


def test_complement_grid_of_rows_equals_a_fit_per_point(spark, monkeypatch):
    vec, vocab = _vectors(spark)
    vec = vec.filter(F.col("label").isNotNull())
    rows = VO.tfidf_rows(vec, VO.idf_table(vec, 60, vocab).checkpoint())
    docs = vec.given.select("doc_id", "label")
    (tr_d, va_d), (tr_w, va_w) = EV.train_validation_split(docs, 0.5), EV.train_validation_split(rows, 0.5)
    got = {(r.alpha, r.norm, r.fit_prior): r.f1 for r in TU.complement_grid_search(tr_w, tr_d, va_w, va_d, vocab).collect()}
    assert len(got) == 16
    for alpha, norm in ((0.1, True), (2.0, False)):
        pred = NB.complement_score(NB.complement_fit(tr_w.long(), tr_d, vocab, alpha=alpha, norm=norm), va_w.long(), va_d.select("doc_id"))
        want = EV.classification_metrics(pred.join(va_d, "doc_id")).first().f1
        assert got[alpha, norm, True] == got[alpha, norm, False] == pytest.approx(want, abs=1e-9)
    long = {(r.alpha, r.norm, r.fit_prior): r.f1 for r in TU.complement_grid_search(tr_w.long(), tr_d, va_w.long().drop("label"), va_d, vocab).collect()}
    assert long == pytest.approx(got, abs=1e-9)
    none = va_w.filter(F.lit(False)), va_d.filter(F.lit(False))
    empty = TU.complement_grid_search(tr_w, tr_d, *none, vocab).collect()
    assert len(empty) == 16 and {r.f1 for r in empty} == {None}


def test_numeric_features_stay_in_the_row(spark):
    extra = [(F.col("doc_id") % 3).cast("double").alias("x"), F.when(F.col("doc_id") % 2 == 0, -1.5).alias("y")]
    vec, vocab = _vectors(spark, keep=("label", "x", "y"), extra=extra)
    vec.keep = ("label",)
    wide = vec.given.select("doc_id", "label", "x", "y")
    idf = VO.idf_table(vec, 60, vocab).checkpoint()
    names = ["x", "y", "missing"]
    rows = VO.union_rows(VO.tfidf_rows(vec, idf), wide, names, ("label",))
    long = VO.union_rows(VO.tfidf(vec, idf), wide, names, ("label",))
    assert isinstance(rows, VO.TermRows)
    _same(rows.label_sums(), long.groupBy("label", "term").agg(F.sum("w").alias("x")), ("label", "term"))
    _same(rows.long(), long, ("doc_id", "term"))
    present = VO.union_rows(vec.present(), wide, names, ("label",))
    plain = VO.union_rows(vec.long().withColumn("w", F.lit(1.0)), wide, names, ("label",)).filter("w > 0")
    _same(present.label_sums(), plain.groupBy("label", "term").agg(F.count(F.lit(1)).cast("double").alias("x")), ("label", "term"))
