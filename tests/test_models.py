"""Naive Bayes model tables on hand-checkable micro fixtures."""
import math

from pyspark.sql import functions as F

from finlex.operators import evaluate as EV
from finlex.operators import naive_bayes as NB


def test_bernoulli_hand_computed(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id BIGINT, label STRING")
    terms = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (2, "a", "y"), (3, "b", "y")],
                                  "doc_id BIGINT, label STRING, term STRING")
    vocab = spark.createDataFrame([("x", 0), ("y", 1)], "term STRING, idx INT")
    m = NB.bernoulli_fit(terms, docs, vocab)
    th = {(r.label, r.term): r.log_p for r in m.theta.collect()}
    assert math.isclose(th[("a", "x")], math.log(3 / 4))   # (2+1)/(2+2)
    assert math.isclose(th[("b", "x")], math.log(1 / 3))   # (0+1)/(1+2)
    pred = NB.bernoulli_score(m, terms.filter("doc_id = 1"), docs.select("doc_id").filter("doc_id = 1")).first()
    # hand: a: ln(2/3) + ln(3/4) + ln(1 - 2/4);  b: ln(1/3) + ln(1/3) + ln(1 - 2/3)
    ja = math.log(2 / 3) + math.log(3 / 4) + math.log(2 / 4)
    jb = math.log(1 / 3) + math.log(1 / 3) + math.log(1 / 3)
    pa = math.exp(ja) / (math.exp(ja) + math.exp(jb))
    assert pred.predicted_class == "a" and math.isclose(pred.confidence, pa, rel_tol=1e-9)
    assert math.isclose(sum(pred.probabilities.values()), 1.0)


def test_gaussian_probabilities_sum_to_one(spark):
    rows = [(i, "hi" if i % 2 else "lo", "f", float(i % 2) * 3 + (i % 5) * 0.1) for i in range(40)]
    long = spark.createDataFrame(rows, "doc_id BIGINT, label STRING, feature STRING, x DOUBLE")
    docs = long.select("doc_id", "label").distinct()
    m = NB.gaussian_fit(long, docs)
    pred = NB.gaussian_score(m, long.drop("label"), docs.select("doc_id"))
    sums = pred.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in sums.collect())
    acc = EV.classification_metrics(pred.join(docs, "doc_id")).first().accuracy
    assert acc == 1.0


def test_threshold_sweep_lowest_on_ties(spark):
    pl = spark.createDataFrame([(1, "a", 0.95, "a"), (2, "a", 0.1, "b")],
                               "doc_id BIGINT, class STRING, prob DOUBLE, true_class STRING")
    r = EV.threshold_sweep(pl).first()
    assert r.threshold == 0.30 and r.best_f1 == 1.0


def test_grid_search_scales_by_the_training_rows_of_each_fold(spark):
    import numpy as np

    from finlex.operators import tuning as TU
    rng = np.random.default_rng(1)
    n = 240
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + np.stack([y * 1.0, y * 20.0], 1)
    rows = [(int(d), f"c{y[d]}", f"f{j}", float(x[d, j])) for d in range(n) for j in range(2)]
    long = spark.createDataFrame(rows, "doc_id BIGINT, label STRING, feature STRING, x DOUBLE")
    docs = long.select("doc_id", "label").distinct()
    grid = [1e-9, 0.5]
    got = {r.var_smoothing: r.f1 for r in TU.gaussian_grid_search(long, docs, k=3, grid=grid).collect()}
    fold = {r.doc_id: r.fold for r in EV.kfold(docs, 3).collect()}
    f = np.array([fold[d] for d in range(n)])
    for vs in grid:
        pred = np.zeros(n, int)
        for h in range(3):
            tr, te = f != h, f == h
            m, s = x[tr].mean(0), x[tr].std(0)
            a, b = (x[tr] - m) / s, (x[te] - m) / s
            eps = vs * a.var(0).max()
            j = np.stack([np.log((y[tr] == c).mean()) - 0.5 * (np.log(2 * np.pi * (a[y[tr] == c].var(0) + eps))
                          + (b - a[y[tr] == c].mean(0)) ** 2 / (a[y[tr] == c].var(0) + eps)).sum(1) for c in range(3)])
            pred[te] = j.argmax(0)
        f1 = 0.0
        for c in range(3):
            tp = ((pred == c) & (y == c)).sum()
            p, r = tp / max((pred == c).sum(), 1), tp / (y == c).sum()
            f1 += (2 * p * r / (p + r) if p + r else 0) * (y == c).mean()
        assert abs(got[vs] - f1) < 1e-9
