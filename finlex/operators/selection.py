"""Model selection and calibration as single jobs.

* Gaussian grid over ``var_smoothing`` x ``k`` best features: counts, sums and squares once
  per (fold, class); every fold's scaler, ANOVA ranks and densities follow from them by
  subtraction.  A held-out row's log densities are summed up to each k, so one pass of array
  products over the rows scores every k and every smoothing; a task hands on confusion counts.
* Complement grid over alpha x norm x fit_prior: one array of weights per term with a value
  for every class and point, one scoring pass.
* Calibration: a one-vs-rest logistic curve per class, fitted by Newton steps whose sums are
  one aggregation each; the curves are a table of (class, slope, offset, threshold), saved
  with a model and applied in the row.

Collected are only model numbers: folds x classes x features, or classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as EV
from . import naive_bayes as NB

# FIXED VALUES: grids of the reference's tuning.
VAR_SMOOTHING_GRID = [1e-11, 1e-10, 1e-9, 1e-8, 1e-7]
K_GRID = [5, 10, 15, 20, 25, 30]
ALPHA_GRID = [0.1, 0.5, 1.0, 2.0]
NORM_GRID = [True, False]
FIT_PRIOR_GRID = [True, False]

CONSTANT = 1e-18       # a variance up to here is a constant feature's
NEWTON_STEPS = 12
RIDGE = 1e-6           # keeps a step defined when a class's log-odds are constant
LOG_ODDS = 20.0        # log-odds are cut here


def weighted_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    """L13 per group: (*by, accuracy, f1) from confusion counts (*by, t, p, c)."""
    zero = F.lit(0)
    sides = F.array(F.struct(F.col("t").alias("cls"), F.col("c").alias("support"), zero.cast("long").alias("said"),
                             F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(zero).alias("hit")),
                    F.struct(F.col("p").alias("cls"), zero.cast("long").alias("support"), F.col("c").alias("said"), zero.cast("long").alias("hit")))
    per = counts.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    # 2PR / (P + R) = 2 hit / (support + said); a class that is never true has no weight
    return per.groupBy(*by).agg((F.sum("hit") / F.sum("support")).alias("accuracy"),
                                (F.sum(2.0 * F.col("hit") / (F.col("support") + F.col("said")) * F.col("support")) / F.sum("support")).alias("f1"))


def _first_best(scores: list[Column], classes: list[str]) -> Column:
    """The class of the greatest score, the first on ties."""
    if len(scores) == 1:
        return F.lit(classes[0])
    top = F.greatest(*scores)
    out = None
    for s, c in zip(scores, classes):
        out = F.when(s == top, F.lit(c)) if out is None else out.when(s == top, F.lit(c))
    return out


# ---------------------------------------------------------------- L15 Gaussian grid

def fold_sums(wide: DataFrame, features: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """(fold, label, n, s ARRAY, q ARRAY): count, sums and squares of every feature.  One aggregation."""
    x = [F.col(f).cast("double") for f in features]
    return EV.kfold(wide, folds, seed).groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("q"))


def ranked(stats: dict[str, tuple[int, list[float], list[float]]], features: list[str]) -> list[int]:
    """L11 ranks of scaled features from (n, means, variances) per class: ANOVA F to nine digits, ties by name."""
    total, k = sum(n for n, _, _ in stats.values()), len(stats)
    keys = []
    for i, name in enumerate(features):
        between = sum(n * m[i] * m[i] for n, m, _ in stats.values())  # scaled: the overall mean is zero
        within = sum(n * v[i] for n, _, v in stats.values())
        f = (between / (k - 1)) / (within / (total - k)) if within > 1e-9 and k > 1 and total > k else 0.0
        e = math.floor(math.log10(f)) if f > 0 else None
        keys.append((e is None, -(e or 0), -round(f / 10.0 ** (e or 0), 8), name))
    return sorted(range(len(features)), key=lambda i: keys[i])


def _fold_models(rows, features: list[str], folds: int, smoothing: list[float]) -> tuple[list[str], list[tuple]]:
    """Per held-out fold: order of features, and (mean, half precision, log term) by smoothing, class and rank."""
    classes = sorted({r.label for r in rows if r.label is not None})
    models = []
    for held in range(folds):
        sums = {}
        for r in rows:
            if r.fold != held:
                n, s, q = sums.get(r.label, (0, [0.0] * len(features), [0.0] * len(features)))
                sums[r.label] = (n + r.n, [a + b for a, b in zip(s, r.s)], [a + b for a, b in zip(q, r.q)])
        total = sum(n for n, _, _ in sums.values())
        if not total:
            continue
        means = [sum(s[i] for _, s, _ in sums.values()) / total for i in range(len(features))]
        spread = [max(sum(q[i] for _, _, q in sums.values()) / total - means[i] ** 2, 0.0) for i in range(len(features))]
        scale = [math.sqrt(v) if v > CONSTANT else 1.0 for v in spread]
        largest = max(v / (s * s) for v, s in zip(spread, scale))
        stats = {c: (n, [(s[i] / n - means[i]) / scale[i] for i in range(len(features))],
                     [max(q[i] / n - (s[i] / n) ** 2, 0.0) / scale[i] ** 2 for i in range(len(features))]) for c, (n, s, q) in sums.items()}
        order = ranked(stats, features)
        params, priors = [], [math.log(sums[c][0] / total) if c in sums else -math.inf for c in classes]
        for vs in smoothing:
            per_class = []
            for c in classes:
                row = []
                for i in order:
                    if c not in stats:
                        row.append((0.0, 0.0, 0.0))
                        continue
                    _, m, v = stats[c]
                    var = v[i] + vs * largest
                    # densities of the scaled value, written for the unscaled one
                    row.append((means[i] + m[i] * scale[i], 0.5 / (var * scale[i] ** 2), 0.5 * math.log(2 * math.pi * var)) if var > 0 else (0.0, 0.0, 0.0))
                per_class.append(row)
            params.append(per_class)
        models.append((held, order, params, priors))
    return classes, models


def fold_predictions(rows: DataFrame, features: list[str], classes: list[str], models: list[tuple], n_smoothing: int, cuts: list[int]) -> DataFrame:
    """(point, t, p, c): how often label ``t`` is taken for ``p`` among a task's rows at each point (smoothing-major, then cut).

    ``rows``: (label, fold, one column a feature).  Each row is scored by its fold's model; the first class
    wins ties.  One pass of array products: the squared distances of a class times its precisions up to each
    cut.  A row without a value for one of a point's features has no prediction there.
    """
    made = {}
    for held, order, params, priors in models:
        per_class = []
        for c in range(len(classes)):
            p = np.array([params[v][c] for v in range(n_smoothing)], dtype=np.float64)  # smoothing x rank x (m, h, l)
            used = np.arange(len(order))[:, None] < np.array(cuts)  # rank x cut
            h = np.where(used[None], p[:, :, 1][:, :, None], 0.0).transpose(1, 0, 2).reshape(len(order), -1)
            logs = np.where(used[None], p[:, :, 2][:, :, None], 0.0).sum(1).reshape(-1)
            mean = p[p[:, :, 1].argmax(0), np.arange(len(order)), 0]  # the same at every smoothing that has a density
            per_class.append((mean, h, priors[c] - logs))
        made[held] = np.array(order), per_class
    last = np.tile(cuts, n_smoothing)
    n_points, n_classes = len(last), len(classes)
    names = pa.array(map(str, classes), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}  # counts by point and class, the last without a prediction
        for b in batches:
            label, fold = b.column(0).dictionary_encode(), b.column(1).to_numpy(zero_copy_only=False)
            code = label.indices.fill_null(len(label.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], axis=1)
            for f in np.unique(fold):
                if f not in made:
                    continue
                order, per_class = made[f]
                mine = np.flatnonzero(fold == f)
                v = x[mine][:, order]
                gone = np.isnan(v)
                best, said = None, np.zeros((len(mine), n_points), dtype=np.int64)
                for c, (mean, h, const) in enumerate(per_class):
                    d = v - mean
                    score = const - np.where(gone, 0.0, d * d) @ h
                    if best is None:
                        best = score
                    else:
                        said[score > best] = c
                        best = np.maximum(best, score)
                if gone.any():
                    first = np.where(gone.any(1), gone.argmax(1), len(order))
                    said[first[:, None] < last] = n_classes
                key = (code[mine][:, None] * n_points + np.arange(n_points)) * (n_classes + 1) + said
                n = np.bincount(key.ravel(), minlength=(len(label.dictionary) + 1) * n_points * (n_classes + 1)).reshape(-1, n_points, n_classes + 1)
                for t, found in zip([*label.dictionary.to_pylist(), None], n):
                    if found.any():
                        held[t] = held[t] + found if t in held else found
        for t, n in held.items():
            point, said = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(point, pa.int32()), pa.array([t] * len(point), pa.string()),
                                              names.take(pa.array(np.where(said < n_classes, said, -1), pa.int64(), mask=said == n_classes)),
                                              pa.array(n[point, said], pa.int64())], ["point", "t", "p", "c"])

    return rows.filter("fold IS NOT NULL").select(F.col("label").cast("string"), "fold", *[F.col(f).cast("double").alias(f) for f in features]) \
        .mapInArrow(run, "point INT, t STRING, p STRING, c BIGINT")


def gaussian_grid(wide: DataFrame, features: list[str], folds: int = 5, seed: int = 42,
                  smoothing: list[float] = VAR_SMOOTHING_GRID, ks: list[int] = K_GRID) -> DataFrame:
    """(var_smoothing, k, f1) over the held-out predictions of all folds; a k beyond the features takes all.

    ``wide``: (doc_id, label, one column a feature), best a materialized table.
    """
    classes, models = _fold_models(fold_sums(wide, features, folds, seed).collect(), features, folds, smoothing)
    cuts = sorted({min(k, len(features)) for k in ks})
    points = F.array(*[F.array(*[F.struct(F.lit(vs).alias("var_smoothing"), F.lit(k).alias("k")) for k in ks if min(k, len(features)) == cut])
                       for vs in smoothing for cut in cuts])
    counts = fold_predictions(EV.kfold(wide, folds, seed), features, classes, models, len(smoothing), cuts)
    counts = counts.groupBy("point", "t", "p").agg(F.sum("c").alias("c")).select(
        F.inline(F.element_at(points, F.col("point") + 1)), "t", "p", "c")
    return weighted_f1(counts, ["var_smoothing", "k"]).select("var_smoothing", "k", "f1")


def best_point(grid: DataFrame, *params: str) -> dict:
    """The point of the greatest F1 (to nine digits), the first in the order of ``params`` on ties."""
    row = grid.orderBy(F.round("f1", 9).desc(), *params).first()
    return {p: row[p] for p in params}


# ---------------------------------------------------------------- L16 Complement grid

def complement_grid(train_w: DataFrame, train_docs: DataFrame, valid_w: DataFrame, valid_docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(alpha, norm, fit_prior, f1), all points from one fit and one scoring pass.

    ``train_w`` (doc_id, label, term, w), ``valid_w`` (doc_id, term, w).  With several classes
    the prior does not enter a complement score, so fit_prior repeats a point.
    """
    classes = NB.class_list(train_docs)
    fc = NB.label_sums(train_w).withColumnRenamed("x", "fc")
    per_term = vocab.select("term").join(fc.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "fc"))).alias("m")), "term", "left") \
        .select("term", *[F.coalesce(F.col("m")[c], F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(classes)])
    total = sum((F.col(f"f{i}") for i in range(len(classes))), F.lit(0.0))
    pairs = [(a, i) for a in range(len(ALPHA_GRID)) for i in range(len(classes))]
    comp = per_term.select("term", *[(total + ALPHA_GRID[a] - F.col(f"f{i}")).alias(f"c{a}_{i}") for a, i in pairs]).checkpoint()
    # one row of sums: classes x alphas numbers, twice
    sums = comp.agg(*[F.sum(f"c{a}_{i}").alias(f"c{a}_{i}") for a, i in pairs]).first()
    logged = comp.select("term", *[F.log(F.col(f"c{a}_{i}") / sums[f"c{a}_{i}"]).alias(f"l{a}_{i}") for a, i in pairs])
    norms = logged.agg(*[F.sum(f"l{a}_{i}").alias(f"l{a}_{i}") for a, i in pairs]).first()
    points = [(a, norm) for a in range(len(ALPHA_GRID)) for norm in NORM_GRID]
    weights = logged.select("term", *[(F.col(f"l{a}_{i}") / norms[f"l{a}_{i}"] if norm else -F.col(f"l{a}_{i}")).alias(f"w{p}_{i}")
                                      for p, (a, norm) in enumerate(points) for i in range(len(classes))])
    names = [f"w{p}_{i}" for p in range(len(points)) for i in range(len(classes))]
    side = F.broadcast(weights) if vocab.count() * len(names) <= NB.BROADCAST_WEIGHTS else weights
    scored = valid_w.select("doc_id", "term", F.col("w").alias("x")).join(side, "term") \
        .select("doc_id", *[(F.col("x") * F.col(n)).alias(n) for n in names])
    zero = valid_docs.select("doc_id", *[F.lit(0.0).alias(n) for n in names])
    scored = zero.unionByName(scored).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])
    said = F.array(*[F.struct(F.lit(ALPHA_GRID[a]).alias("alpha"), F.lit(norm).alias("norm"), _first_best(
        [F.col(f"w{p}_{i}") for i in range(len(classes))], classes).alias("p")) for p, (a, norm) in enumerate(points)])
    counts = scored.join(valid_docs.select("doc_id", F.col("label").alias("t")), "doc_id").select("t", F.inline(said)) \
        .groupBy("alpha", "norm", "t", "p").agg(F.count(F.lit(1)).alias("c"))
    return weighted_f1(counts, ["alpha", "norm"]).select(
        "alpha", "norm", F.explode(F.array(*[F.lit(x) for x in FIT_PRIOR_GRID])).alias("fit_prior"), "f1")


# ---------------------------------------------------------------- L12 calibration

def log_odds(p: Column) -> Column:
    return F.when(p <= 0, -LOG_ODDS).when(p >= 1, LOG_ODDS).otherwise(
        F.greatest(F.lit(-LOG_ODDS), F.least(F.lit(LOG_ODDS), F.log(p) - F.log(1 - p))))


def fit_calibration(probs_long: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """(class, slope, offset, threshold), a logistic curve on each class's log-odds.

    ``probs_long``: (doc_id, class, prob, true_class) of rows the model was not fitted on.
    Targets are smoothed to (n+ + 1) / (n+ + 2) and 1 / (n- + 2), so separable classes have a
    finite curve.  Each Newton step is one aggregation of five sums per class; ``threshold``
    has the best F1 on the calibrated probabilities of the same rows (L17).
    """
    spark = probs_long.sparkSession
    x = probs_long.select("doc_id", "class", "true_class", log_odds(F.col("prob")).alias("z"),
                          (F.col("class") == F.col("true_class")).alias("y")).checkpoint()
    n = {r["class"]: (r.pos, r.neg) for r in x.groupBy("class").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).collect()}
    curve = {c: (0.0, math.log((pos + 1.0) / (neg + 1.0))) for c, (pos, neg) in n.items()}
    for _ in range(steps):
        if not curve:
            break
        num = lambda values: F.create_map(*[F.lit(v) for c in sorted(curve) for v in (c, values(c))])[F.col("class")]
        t = F.when(F.col("y"), num(lambda c: (n[c][0] + 1.0) / (n[c][0] + 2.0))).otherwise(num(lambda c: 1.0 / (n[c][1] + 2.0)))
        p = 1 / (1 + F.exp(-(F.col("z") * num(lambda c: curve[c][0]) + num(lambda c: curve[c][1]))))
        d = x.select("class", "z", t.alias("t"), p.alias("p")).select("class", "z", (F.col("p") - F.col("t")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        for r in d.groupBy("class").agg(F.sum(F.col("g") * F.col("z")).alias("ga"), F.sum("g").alias("gb"),
                                        F.sum(F.col("h") * F.col("z") * F.col("z")).alias("aa"), F.sum(F.col("h") * F.col("z")).alias("ab"),
                                        F.sum("h").alias("bb")).collect():  # one row a class
            aa, bb = r.aa + RIDGE, r.bb + RIDGE
            det = aa * bb - r.ab * r.ab
            a, b = curve[r["class"]]
            curve[r["class"]] = (a - (bb * r.ga - r.ab * r.gb) / det, b - (aa * r.gb - r.ab * r.ga) / det)
    curves = spark.createDataFrame([(c, *ab) for c, ab in sorted(curve.items())], "class STRING, slope DOUBLE, offset DOUBLE")
    raw = x.join(F.broadcast(curves), "class").select("doc_id", "class", "true_class", (1 / (1 + F.exp(-(F.col("z") * F.col("slope") + F.col("offset"))))).alias("s"))
    prob = raw.withColumn("prob", F.col("s") / F.sum("s").over(Window.partitionBy("doc_id")))
    return curves.join(EV.threshold_sweep(prob).select("class", "threshold"), "class")


def calibrated(pred: DataFrame, calibration: DataFrame) -> DataFrame:
    """L12 / L18 at scoring: ``pred`` with calibrated probabilities, confidence and predicted_class.  A projection.

    The class is that of the greatest calibrated probability among those at or above their
    threshold, of the greatest at all when none is; the first in order on ties.
    """
    curves = {r["class"]: r for r in calibration.collect()}  # one row a class
    classes = sorted(curves)
    raw = [1 / (1 + F.exp(-(log_odds(F.col("probabilities")[c]) * curves[c].slope + curves[c].offset))) for c in classes]
    out = pred.select(*pred.columns, *[r.alias(f"__r{i}") for i, r in enumerate(raw)])
    total = sum((F.col(f"__r{i}") for i in range(len(classes))), F.lit(0.0))
    out = out.select(*pred.columns, *[(F.col(f"__r{i}") / total).alias(f"__c{i}") for i in range(len(classes))])
    chosen = F.array(*[F.struct((F.col(f"__c{i}") >= curves[c].threshold).alias("ok"), F.col(f"__c{i}").alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
                       for i, c in enumerate(classes)])
    best = F.array_max(chosen)
    kept = [c for c in pred.columns if c not in ("predicted_class", "confidence", "probabilities")]
    return out.select(*kept, best["c"].alias("predicted_class"), best["p"].alias("confidence"),
                      F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.col(f"__c{i}") for i in range(len(classes))])).alias("probabilities"))
