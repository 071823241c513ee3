"""Splits, metrics, threshold calibration and AUC.

All are aggregations over prediction tables; nothing is collected except
results bounded by the number of classes or grid points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_MOD = 1_000_003
SPLIT_MULT = 7919


def split_bucket(doc_id: str | Column, seed: int = 42) -> Column:
    """Deterministic 0-99 bucket from the document key and seed.

    Row-local (no window keyed by label), so a dominant class cannot pile onto
    one task; stratification holds in expectation in every class.
    """
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.pmod(d, F.lit(SPLIT_MOD)) * SPLIT_MULT + seed, F.lit(SPLIT_MOD)) % 100


def train_validation_split(df: DataFrame, fraction: float = 0.2, seed: int = 42,
                           key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """L1: (train, validation)."""
    b = split_bucket(key, seed)
    cut = int(round(fraction * 100))
    return df.filter(b >= cut), df.filter(b < cut)


SPLIT_BUCKETS = 1024


def stratified_split(df: DataFrame, label: str = "label", fraction: float = 0.2, seed: int = 42,
                     key: str = "doc_id") -> DataFrame:
    """L1, exact: ``df`` with ``split``; every label gives round(fraction x its rows) to validation.

    Rows fall into hash buckets of the key (any type).  From (label, bucket) counts follows
    the bucket in which a label's share ends; only that bucket's rows are ranked, so no task
    sorts a label's rows, however many it has.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(SPLIT_BUCKETS)))
    counts = b.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(label).orderBy("_b")
    cum = counts.withColumn("upto", F.sum("c").over(upto)).withColumn(
        "want", F.round(F.sum("c").over(Window.partitionBy(label)) * fraction))
    cut = cum.filter(F.col("upto") >= F.col("want")).groupBy(F.col(label).alias("_l")).agg(
        F.min_by(F.struct(F.col("_b").alias("at"), (F.col("want") - F.col("upto") + F.col("c")).alias("left")), "_b").alias("_cut"))
    j = b.join(cut, F.col(label).eqNullSafe(F.col("_l")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key))
    edge = j.filter(F.col("_b") == F.col("_cut.at")).withColumn(
        "split", F.when(rank <= F.col("_cut.left"), "validation").otherwise("train"))
    rest = j.filter(F.col("_b") != F.col("_cut.at")).withColumn(
        "split", F.when(F.col("_b") < F.col("_cut.at"), "validation").otherwise("train"))
    return rest.unionByName(edge).select(*df.columns, "split")


def kfold(df: DataFrame, k: int = 5, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Fold id 0..k-1 from the same row-local bucket."""
    return df.withColumn("fold", (split_bucket(key, seed) % k).cast("int"))


def classification_metrics(pred: DataFrame, label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0 when undefined)."""
    conf = pred.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    none = F.lit(0).cast("long")
    sides = F.array(  # a count is its true class's support and its predicted class's: the rows are counted once
        F.struct(F.col("t").alias("cls"), F.col("c").alias("support"), none.alias("npred"), none.alias("tp")),
        F.struct(F.col("p").alias("cls"), none.alias("support"), F.col("c").alias("npred"),
                 F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(none).alias("tp")))
    per = conf.select(F.inline(sides)).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "npred", "tp")])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("prec", prec).withColumn("rec", rec).withColumn(
        "f1", F.when(F.col("prec") + F.col("rec") > 0,
                     2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0))
    n = F.sum("support")
    return per.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"),
        n.cast("bigint").alias("n"))


def training_metadata(train_docs: DataFrame, n_features: int | Column) -> DataFrame:
    """Samples and features (repeated) with the class distribution."""
    counts = train_docs.groupBy("label").agg(F.count(F.lit(1)).alias("class_count"))
    w = Window.partitionBy()
    return counts.select("label", "class_count", F.sum("class_count").over(w).alias("samples"),
                         F.lit(n_features).cast("bigint").alias("features"))


# FIXED VALUES: threshold grid (0.30 to 0.90 in 0.05 steps, 13 values).
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]


def threshold_sweep(probs_long: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Per class the threshold with the best F1 (lowest on ties; 0.5 when none > 0).

    ``probs_long``: (doc_id, class, prob, true_class).  Rows are counted by how many thresholds they
    reach; only these counts are expanded by the fixed 13-value grid.
    """
    ranks = {t: i for i, t in enumerate(sorted(set(thresholds)))}
    reached = sum(((F.col("prob") >= t).cast("int") for t in ranks), F.lit(0))
    held = probs_long.select("class", (F.col("true_class") == F.col("class")).alias("pos"), reached.alias("reached")) \
        .groupBy("class", "pos", "reached").agg(F.count(F.lit(1)).alias("c"))
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(ranks[t]).alias("rank")) for t in thresholds])
    x = held.select("class", "pos", "reached", "c", F.inline(grid))
    yes = F.col("reached") > F.col("rank")
    agg = x.groupBy("class", "threshold").agg(
        F.sum((yes & F.col("pos")).cast("long") * F.col("c")).alias("tp"),
        F.sum((yes & ~F.col("pos")).cast("long") * F.col("c")).alias("fp"),
        F.sum((~yes & F.col("pos")).cast("long") * F.col("c")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    agg = agg.withColumn("p", p).withColumn("r", r).withColumn(
        "f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
        .otherwise(0.0))
    best = agg.withColumn("rn", F.row_number().over(
        Window.partitionBy("class").orderBy(F.col("f1").desc(), F.col("threshold"))))
    return best.filter("rn = 1").select(
        "class", F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"),
        F.col("f1").alias("best_f1"))


def ranges_of_values(probs_long: DataFrame, partitions: int | None = None) -> DataFrame:
    """(class, prob, c, cp, part): distinct probabilities with their rows and positives, in balanced ranges.

    Equal probabilities are one row, so a value that half the rows hold is no hot key; the
    range boundaries come from Spark's sample of the distinct values, so they follow the data
    where values crowd.  Written once: the part numbers must not change between reads.
    """
    x = probs_long.select("class", "prob", (F.col("true_class") == F.col("class")).cast("long").alias("pos"))
    v = x.groupBy("class", "prob").agg(F.count(F.lit(1)).alias("c"), F.sum("pos").alias("cp"))
    v = v.repartitionByRange(partitions, "class", "prob") if partitions else v.repartitionByRange("class", "prob")
    return v.withColumn("part", F.spark_partition_id()).checkpoint()


def one_vs_rest_auc(probs_long: DataFrame, partitions: int | None = None) -> DataFrame:
    """ROC AUC per class by the rank-sum formula (ties get average ranks).

    Exact ranks without one window per class: a value's rank is the rows in the ranges
    before its own (a running sum over one row a class and range) plus those before it in
    its range (a window keyed by class and range).
    """
    v = ranges_of_values(probs_long, partitions)
    tot = v.groupBy("class", "part").agg(F.sum("c").alias("bc"))
    tot = tot.withColumn("offset", F.coalesce(F.sum("bc").over(
        Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("class", "part").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("within", F.coalesce(F.sum("c").over(w), F.lit(0))) \
        .join(tot.select("class", "part", "offset"), ["class", "part"])
    v = v.withColumn("avg_rank", F.col("offset") + F.col("within") + (F.col("c") + 1) / 2.0)
    s = v.groupBy("class").agg(F.sum(F.col("avg_rank") * F.col("cp")).alias("rs"),
                               F.sum("cp").alias("npos"), F.sum("c").alias("n"))
    nneg = F.col("n") - F.col("npos")
    return s.select("class", F.when((F.col("npos") > 0) & (nneg > 0),
                                    (F.col("rs") - F.col("npos") * (F.col("npos") + 1) / 2.0)
                                    / (F.col("npos") * nneg)).alias("auc"))
