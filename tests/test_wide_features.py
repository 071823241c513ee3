"""Models and grids over one column a feature: against the long form and plain counts, without a row a feature."""
import random

import pytest
from pyspark.sql import functions as F

from finlex.functions import features as FE
from finlex.operators import evaluate as EV
from finlex.operators import naive_bayes as NB
from finlex.operators import selection as SE
from finlex.operators import tuning as TU

NAMES = ["a", "b", "c", "flat"]


def _rows(n=300, seed=3):
    rng = random.Random(seed)
    return [(k, c, rng.gauss("xyz".index(c), 1.5), rng.gauss(0, 30), rng.random(), 2.0) for k in range(n) for c in [rng.choice("xxyz")]]


def _table(spark, rows):
    wide = spark.createDataFrame(rows, "doc_id LONG, label STRING, a DOUBLE, b DOUBLE, c DOUBLE, flat DOUBLE")
    return wide, NB.unpivot_features(wide, NAMES, keep=("doc_id", "label"))


@pytest.mark.parametrize("twice", [False, True])
def test_grid_search_of_columns_equals_the_long_form(spark, monkeypatch, twice):
    rows = _rows()
    wide, long = _table(spark, [*rows, *rows[:40]] if twice else rows)
    docs, grid = wide.select("doc_id", "label"), [1e-9, 0.5]
    want = {r.var_smoothing: r.f1 for r in TU.gaussian_grid_search(long, docs, k=3, grid=grid).collect()}
    if not twice:  # no row a feature is made
        monkeypatch.setattr(NB.FeatureRows, "long", None)
    got = {r.var_smoothing: r.f1 for r in TU.gaussian_grid_search(NB.FeatureRows(wide, NAMES), docs, k=3, grid=grid).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 2


def test_grid_search_without_rows_has_every_point(spark):
    wide, _ = _table(spark, [])
    got = TU.gaussian_grid_search(NB.FeatureRows(wide, NAMES), wide.select("doc_id", "label"), grid=[1e-9, 0.5]).collect()
    assert sorted(r.var_smoothing for r in got) == [1e-9, 0.5] and {r.f1 for r in got} == {None}


def test_grid_scores_batches_without_a_lambda_a_feature(spark):
    wide, _ = _table(spark, _rows())
    plan = SE.gaussian_grid(wide, NAMES)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_fit_of_columns_equals_the_long_form(spark):
    wide, long = _table(spark, _rows())
    docs = wide.select("doc_id", "label")
    a, b = NB.gaussian_fit(long, docs), NB.gaussian_fit(NB.FeatureRows(wide, NAMES), docs)
    for x, y, key in ((a.scaler, b.scaler, ("feature",)), (a.stats, b.stats, ("label", "feature"))):
        x, y = ({tuple(r[k] for k in key): [v for k, v in r.asDict().items() if k not in key] for r in t.collect()} for t in (x, y))
        assert x.keys() == y.keys() and all(y[k] == pytest.approx(x[k], rel=1e-9, abs=1e-12) for k in x)
    assert {r.feature: r.std for r in b.scaler.collect()}["flat"] == 1.0
    f = {r.feature: r.f_score for r in NB.anova_f(long).collect()}
    g = {r.feature: r.f_score for r in NB.anova_f(NB.FeatureRows(wide, NAMES)).collect()}
    assert f["flat"] is None is g["flat"] and all(g[k] == pytest.approx(f[k]) for k in ("a", "b", "c"))


def test_score_without_a_value_leaves_its_feature_out(spark):
    wide, long = _table(spark, _rows())
    m = NB.gaussian_fit(NB.FeatureRows(wide, NAMES), wide.select("doc_id", "label"))
    some = spark.createDataFrame([(1, 0.5, None, 0.2, 2.0)], "doc_id LONG, a DOUBLE, b DOUBLE, c DOUBLE, flat DOUBLE")
    less = NB.GaussianModel(m.classes, m.prior, m.stats.filter("feature <> 'b'"), m.scaler)
    a, b = NB.gaussian_score_wide(m, some).first(), NB.gaussian_score_wide(less, some).first()
    assert a.predicted_class == b.predicted_class
    stats = {(r.label, r.feature): r for r in m.stats.collect()}
    assert a.probabilities == pytest.approx(b.probabilities, abs=0.2) and len(stats) == 12
    assert "lambda" not in NB.gaussian_score_wide(m, wide)._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_are_counted_before_the_grid(spark):
    rng = random.Random(1)
    rows = [(k, c, rng.choice([rng.random(), 0.3, 0.9, 0.05, None]), rng.choice(["u", "v", None])) for k in range(400) for c in "uv"]
    got = EV.threshold_sweep(spark.createDataFrame(rows, "doc_id LONG, class STRING, prob DOUBLE, true_class STRING"))
    for r in got.collect():
        best = (-1.0, None)
        for t in EV.THRESHOLDS:
            mine = [(p >= t, y == r["class"]) for _, c, p, y in rows if c == r["class"] and p is not None and y is not None]
            tp, fp = sum(a and b for a, b in mine), sum(a and not b for a, b in mine)
            # a row whose class is not known is no positive, nor is it a false one
            fn = sum(b and not a for a, b in mine)
            best = max(best, (round(2 * tp / (2 * tp + fp + fn), 9) if tp else 0.0, -t))
        assert r.best_f1 == pytest.approx(best[0]) and r.threshold == -best[1]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grid = next(i for i, x in enumerate(plan) if "Generate inline" in x)
    assert any("Aggregate" in x for x in plan[grid:])


def test_metrics_count_the_rows_once(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")]
    d = spark.createDataFrame(rows, "label STRING, predicted_class STRING")
    m = EV.classification_metrics(d)
    r = m.first()
    assert r.n == 5 and r.accuracy == 2 / 5 and r.recall == pytest.approx((1 + 1) / 5)
    assert r.precision == pytest.approx((2 * 1 / 3 + 1 * 1 / 2) / 5)
    assert r.f1 == pytest.approx((2 * 2 / 5 + 2 / 3) / 5)
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert EV.classification_metrics(d.limit(0)).collect()[0].f1 is None


def test_number_patterns_equal_the_plain_ones(spark):
    rng = random.Random(4)
    parts = ["1", "23", "456", ",", ".", " ", " ", "%", "$", "R$", "r$", "reais", "x", "R", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t STRING")
    plain = F.transform(F.regexp_extract_all("t", F.lit(FE.PERCENT_RE), 1), lambda p: F.replace(p, F.lit(","), F.lit(".")).cast("double"))
    assert d.filter(FE.percentages("t") != plain).count() == 0
    assert d.filter(FE.currency_count(F.col("t")) != FE.regexp_count(F.col("t"), FE.CURRENCY_RE)).count() == 0
