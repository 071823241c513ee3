"""Grids, calibration and union models against plain NumPy versions."""
import math

import numpy as np
import pytest

from finlex.operators import evaluate as EV
from finlex.operators import naive_bayes as NB
from finlex.operators import selection as SE
from finlex.operators import vocab as VO

NAMES = ["a", "b", "c", "flat"]


def _bucket(k, seed=42):
    return (k % 1_000_003 * 7919 + seed) % 1_000_003 % 100


def _f1(true, said):
    out = 0.0
    for c in set(true):
        tp = sum(t == c and s == c for t, s in zip(true, said))
        out += 2 * tp / (true.count(c) + said.count(c)) * true.count(c)
    return out / len(true)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for k in range(400):
        c = "xyz"[int(rng.integers(3)) if k % 3 else 0]
        out.append((k, c, float(rng.normal("xyz".index(c), 1.5)), float(rng.normal()), float(rng.exponential(1 + (c == "z"))), 2.0))
    return out


@pytest.fixture(scope="module")
def wide(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, label STRING, a DOUBLE, b DOUBLE, c DOUBLE, flat DOUBLE").cache()


def test_gaussian_grid_equals_refits(wide, rows):
    smoothing, ks = [1e-9, 0.5], [1, 2, 30]
    got = {(r.var_smoothing, r.k): r.f1 for r in SE.gaussian_grid(wide, NAMES, smoothing=smoothing, ks=ks).collect()}
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    fold = np.array([_bucket(r[0]) % 5 for r in rows])
    for vs in smoothing:
        for k in ks:
            true, said = [], []
            for h in range(5):
                tr, te = x[fold != h], x[fold == h]
                ty = y[fold != h]
                m, s = tr.mean(0), tr.std(0)
                s[s < 1e-9] = 1.0
                tr, te = (tr - m) / s, (te - m) / s
                f = []
                for i in range(4):
                    b = sum((ty == c).sum() * tr[ty == c, i].mean() ** 2 for c in "xyz")
                    w = sum(((tr[ty == c, i] - tr[ty == c, i].mean()) ** 2).sum() for c in "xyz")
                    f.append((b / 2) / (w / (len(ty) - 3)) if w > 1e-9 else 0.0)
                best = sorted(range(4), key=lambda i: (-f[i], NAMES[i]))[:k]
                eps = vs * tr.var(0).max()
                j = np.array([math.log((ty == c).mean()) + sum(-0.5 * np.log(2 * math.pi * (tr[ty == c, i].var() + eps))
                                                               - 0.5 * (te[:, i] - tr[ty == c, i].mean()) ** 2 / (tr[ty == c, i].var() + eps) for i in best)
                              for c in "xyz"])
                true += y[fold == h].tolist()
                said += ["xyz"[i] for i in j.argmax(0)]
            assert got[vs, k] == pytest.approx(_f1(true, said), abs=1e-9)
    assert SE.best_point(SE.gaussian_grid(wide, NAMES, smoothing=smoothing, ks=ks), "var_smoothing", "k") in [
        {"var_smoothing": v, "k": k} for (v, k), f in got.items() if f == pytest.approx(max(got.values()))]


def test_complement_grid_equals_a_fit_per_point(spark):
    rng = np.random.default_rng(3)
    terms = [f"t{i}" for i in range(12)]
    docs = [(k, "pq"[k % 2]) for k in range(120)]
    ws = [(k, c, t, float(rng.random() * (1 + 2 * (i % 2 == "pq".index(c))))) for k, c in docs for i, t in enumerate(terms) if rng.random() < 0.4]
    d = spark.createDataFrame(docs, "doc_id LONG, label STRING")
    w = spark.createDataFrame(ws, "doc_id LONG, label STRING, term STRING, w DOUBLE")
    vocab = spark.createDataFrame([(t,) for t in terms], "term STRING")
    (tr_d, va_d), (tr_w, va_w) = EV.train_validation_split(d), EV.train_validation_split(w)
    got = SE.complement_grid(tr_w, tr_d, va_w.drop("label"), va_d, vocab).collect()
    assert len(got) == 16
    for alpha, norm in ((0.1, True), (2.0, False)):
        pred = NB.complement_score(NB.complement_fit(tr_w, tr_d, vocab, alpha=alpha, norm=norm), va_w, va_d.select("doc_id"))
        want = EV.classification_metrics(pred.join(va_d, "doc_id")).first().f1
        assert {round(r.f1, 9) for r in got if r.alpha == alpha and r.norm == norm} == {round(want, 9)}


def test_calibration_reaches_the_curve_of_least_loss(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(0, 2, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.5 * z - 1)))
    p = 1 / (1 + np.exp(-z))
    long = spark.createDataFrame([(k, c, float(q), "u" if t else "v") for k, (a, t) in enumerate(zip(p, y)) for c, q in (("u", a), ("v", 1 - a))],
                                 "doc_id LONG, class STRING, prob DOUBLE, true_class STRING")
    curves = SE.fit_calibration(long)
    u = {r["class"]: r for r in curves.collect()}["u"]
    pos = y.sum()
    t = np.where(y, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    q = 1 / (1 + np.exp(-(u.slope * z + u.offset)))
    assert abs(((q - t) * z).sum()) < 1e-2 and abs((q - t).sum()) < 1e-2  # no slope left at the fitted point
    assert u.slope == pytest.approx(0.5, abs=0.1) and u.offset == pytest.approx(-1, abs=0.15)
    pred = spark.createDataFrame([(1, "u", 0.5, {"u": 0.5, "v": 0.5}), (2, "u", 1.0, {"u": 1.0, "v": 0.0})],
                                 "doc_id LONG, predicted_class STRING, confidence DOUBLE, probabilities MAP<STRING, DOUBLE>")
    got = {r.doc_id: r for r in SE.calibrated(pred, curves).collect()}
    assert got[1].predicted_class == "v" and got[1].confidence == pytest.approx(1 - 1 / (1 + math.exp(1)), abs=0.03)
    assert got[2].predicted_class == "u" and sum(got[2].probabilities.values()) == pytest.approx(1)


def test_calibration_of_separable_and_empty_rows(spark):
    schema = "doc_id LONG, class STRING, prob DOUBLE, true_class STRING"
    flat = spark.createDataFrame([(k, c, float(c == "u") if k % 2 else float(c == "v"), "u" if k % 2 else "v") for k in range(20) for c in "uv"], schema)
    assert all(math.isfinite(r.slope) and math.isfinite(r.offset) for r in SE.fit_calibration(flat).collect())
    assert SE.fit_calibration(flat.limit(0)).count() == 0


def test_union_rows_align_by_name(spark):
    text = spark.createDataFrame([(1, "word", 0.5)], "doc_id LONG, term STRING, w DOUBLE")
    wide = spark.createDataFrame([(1, 3, None, True), (2, 0, 1.5, False)], "doc_id LONG, n INT, x DOUBLE, extra BOOLEAN")
    got = {tuple(r) for r in VO.union_rows(text, wide, ["n", "x", "missing"]).collect()}
    assert got == {(1, "word", 0.5), (1, "#n", 3.0), (2, "#x", 1.5)}


def test_f1_from_counts(spark):
    c = spark.createDataFrame([("g", "a", "a", 3), ("g", "a", "b", 1), ("g", "b", "c", 2)], "k STRING, t STRING, p STRING, c LONG")
    r = SE.weighted_f1(c, ["k"]).first()
    assert r.accuracy == 0.5 and r.f1 == pytest.approx(2 * 3 / (4 + 3) * 4 / 6)


def test_auc_ranges_stay_even_where_probabilities_crowd(spark):
    rng = np.random.default_rng(2)
    p = np.where(rng.random(40_000) < 0.5, np.round(rng.random(40_000)), rng.beta(0.05, 0.05, 40_000))  # half at 0 or 1, the rest next to them
    y = rng.random(40_000) < 0.2 + 0.6 * p
    long = spark.createDataFrame([("u", float(a), "u" if t else "v") for a, t in zip(p, y)], "class STRING, prob DOUBLE, true_class STRING")
    sizes = [r["count"] for r in EV.ranges_of_values(long, 16).groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / len(sizes)
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    values, start, counts = np.unique(p[order], return_index=True, return_counts=True)
    ranks[order] = np.repeat(start + (counts + 1) / 2, counts)
    want = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert EV.one_vs_rest_auc(long, 16).first().auc == pytest.approx(want, abs=1e-12)
