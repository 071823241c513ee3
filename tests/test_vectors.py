"""Term vectors as one row a document: against counts by hand, repeated keys, and what is shuffled."""
import math
from collections import Counter

from finlex.functions import grams as GR
from finlex.operators import vocab as VO
from finlex.sources import fixtures as FX
from tests.conftest import SF_SMALL

CFG = VO.VocabConfig(1, 3, 1, 50)
ROWS = [(1, "x", "aa bb aa bb cc"), (2, "y", "é bb 𝒳 bbé"), (3, "x", ""), (4, None, None), (5, "y", "zz qq")]


def _grams(text):
    w = [x for x in (text or "").split(" ") if len(x) >= 2]
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _vocabulary(rows):
    tf, df = Counter(), Counter()
    for r in rows:
        tf.update(_grams(r[2]))
        df.update(set(_grams(r[2])))
    return {t: (df[t], tf[t]) for t in tf}


def test_vocabulary_and_counts(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id BIGINT, label STRING, t STRING")
    for held in (200_000, 1):  # a task hands on its sums in between
        monkeypatch.setattr(GR, "TERMS_HELD", held)
        vocab = VO.fit_vocabulary(docs, "t", CFG)
        assert {r.term: (r.df, r.tf) for r in vocab.collect()} == _vocabulary(ROWS)
    vec = VO.vectorize(docs.filter("doc_id <> 5"), "t", vocab, CFG, ("label",))
    assert not vec.repeated and vec.given.count() == 4
    got = {(r.doc_id, r.label, r.term): r.n for r in vec.long().collect()}
    assert got == {(i, label, g): n for i, label, t in ROWS[:4] for g, n in Counter(_grams(t)).items()}
    at = {r.term: r.idx for r in vocab.collect()}
    assert all(at[r.term] == r.idx for r in vec.long().collect())


def test_repeated_keys_are_added_up(spark):
    rows = [*ROWS, (1, "x", "bb cc"), (2, "z", "aa"), (None, "x", "aa bb"), (None, "x", "aa")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, label STRING, t STRING")
    vocab = VO.fit_vocabulary(docs, "t", CFG)
    vec = VO.vectorize(docs, "t", vocab, CFG, ("label",))
    assert vec.repeated and vec.given.count() == len(rows)
    want = Counter()
    for i, label, t in rows:
        for g in _grams(t):
            want[i, label, g] += 1
    assert {(r.doc_id, r.label, r.term): r.n for r in vec.long().collect()} == want
    idf = VO.idf_table(vec.long(), 6, vocab)
    of = {r.term: r.idf for r in idf.collect()}
    sq = Counter()
    for (i, _, g), n in want.items():
        sq[i] += (n * of[g]) ** 2
    for r in VO.tfidf(vec, idf).collect():  # the norm is that of all rows of the key
        assert math.isclose(r.w, want[r.doc_id, r.label, r.term] * of[r.term] / math.sqrt(sq[r.doc_id]), rel_tol=1e-12)


def test_weights_of_distinct_keys_need_no_shuffle(spark):
    docs = spark.createDataFrame(ROWS, "doc_id BIGINT, label STRING, t STRING")
    vocab = VO.fit_vocabulary(docs, "t", CFG)
    vec = VO.vectorize(docs, "t", vocab, CFG, ("label",))
    plan = VO.tfidf(vec, VO.idf_table(vec.long(), 5, vocab))._jdf.queryExecution().toString()
    assert "Exchange" not in plan.partition("== Physical Plan ==")[2]
    counts = {r.doc_id: dict(zip(map(int, r.text_vector.indices), r.text_vector.values)) for r in VO.sparse_vectors(vec).collect()}
    assert {(i, t): n for i, v in counts.items() for t, n in v.items()} == {(r.doc_id, r.idx): r.n for r in vec.long().collect()}


def test_orders_are_dealt_before_texts_are_made(spark):
    rows = spark.range(40_000)
    cores = spark.sparkContext.defaultParallelism
    assert FX.spread(rows, "id").rdd.getNumPartitions() == min(8, 4 * cores)
    a, b = FX.ann(spark, SF_SMALL), FX.ann_texts(spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
