"""Quality rules with robust multivariate outliers (operator 5).

A narrow pass takes the base statistics of every whole text.  Per language and source a
minimum-covariance-determinant estimate of the transformed statistic vectors follows, over
all documents: start at the medians and median deviations, then concentration steps; each
keeps the ``support`` share of a group's documents that lie nearest by Mahalanobis
distance and takes their mean and covariance.  Distances are binned on a fixed logarithmic
grid, so a step's cut is exact on the grid, independent of partitioning, and found from
(group, bin) counts; a step's sums are aggregated map-side and only one row a group moves.
A document is rejected when its squared distance exceeds ``cutoff``.

Groups below ``min_group`` documents borrow the estimate of their language, and languages
below it that of all documents.  Each variance is floored at ``FLOOR`` squared, the least
spread worth telling apart, so constant statistics neither break the inverse nor reject a
document for a trifle.

Defined cases: a null text has no words and fails the base rule; null language or source
is a group of its own; repeated rows count each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, map_arrow, materialize, prepare, text_bytes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 5

# transformed statistics and the least spread of each that counts
FLOOR = {"word_length": 0.08, "symbols": 0.05, "dup_lines": 0.10, "repeats": 0.10, "upper": 0.05}
SUPPORT = 0.75
STEPS = 6
MIN_GROUP = 100
CUTOFF = 50.0  # chi-square with 5 degrees of freedom passes this once in 10^9
# consistency factor of the covariance of the nearest 75 % under a normal law, 5 dimensions
CONSISTENCY = 1.41
START_GRID = 512
GRID = 16  # bins per doubling of the squared distance

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice; exact, by renaming longer and longer windows."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for step in range(window):
        mixed = mixed * _MIX + ids[step:step + n].astype(np.uint64)
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():  # equal windows have equal hashes: none repeats
        return 0
    name = ids.astype(np.int64)
    base = int(name.max()) + 1
    code = name[:n]
    for step in range(1, window):
        _, code = np.unique(code * base + name[step:step + n], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(ids) + 1, np.int32)
    edge[:n] += twice
    edge[window:] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(data: bytes) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, ASCII capitals."""
    words = data.split()
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    chars = len(data.translate(None, SPACE + bytes(range(0x80, 0xC0))))  # bytes that begin a code point
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(np.array(ids, np.int64)) if len(number) < len(ids) else 0
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, len(lines), capitals)


def with_statistics(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of ``docs`` (``text`` may be one) with the base statistics of the text; a narrow step."""
    names = [*STATS, "n_lines", "n_capitals"]
    read = keys if text in keys else [*keys, text]
    at = read.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(x) for x in text_bytes(b.column(at))], np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[:len(keys)], *(pa.array(rows[:, k]) for k in range(len(names)))],
                                          [*keys, *names])

    schema = StructType([docs.schema[k] for k in keys] + [StructField(n, LongType()) for n in names])
    return map_arrow(docs.select(*read), batch, schema)


def vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {"word_length": F.log(chars / words),
            "symbols": F.log1p(F.col("n_symbols") / words),
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeats": F.col("n_repeat_words") / words,
            "upper": F.col("n_capitals") / chars}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of the row's vector from ``mean`` by ``inverse`` (upper triangle, row-wise)."""
    terms, k = [], 0
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            x = (F.col(a) - F.col("mean")[i]) * (F.col(names[j]) - F.col("mean")[j]) * F.col("inverse")[k]
            terms.append(x if i == j else 2 * x)
            k += 1
    total = reduce(lambda x, y: x + y, terms)
    return F.when(total < 0, F.lit(0.0)).otherwise(total)


def _estimates(sums: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Group rows with sums -> mean and inverse covariance; a group is one row, so this stays small."""
    p = len(names)
    floor = np.array([FLOOR[n] for n in names])
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in group] + ["n long", "mean array<double>", "inverse array<double>"])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        means, inverses = [], []
        for n, s, q in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("kept", "s", "q"))):
            mean = np.array(s) / n
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.array(q) / n
            cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
            cov = CONSISTENCY * cov
            spread = np.sqrt(np.maximum(np.diag(cov), 0))
            # floor the spreads and keep the correlations away from one
            corr = np.divide(cov, np.outer(spread, spread), out=np.zeros((p, p)), where=np.outer(spread, spread) > 1e-18)
            corr = 0.95 * corr + 0.05 * np.eye(p)
            np.fill_diagonal(corr, 1.0)
            wide = np.maximum(spread, floor)
            inverse = np.linalg.inv(corr * np.outer(wide, wide))
            means.append(mean.tolist())
            inverses.append(inverse[np.triu_indices(p)].tolist())
        return pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(len(group))), b.column(len(group)),
             pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))],
            [*group, "n", "mean", "inverse"])

    return map_arrow(sums.select(*group, "n", "kept", "s", "q"), batch, schema)


def _sums(rows: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    pairs = [F.col(a) * F.col(b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*group).agg(F.max("n").alias("n"), F.count("*").alias("kept"),
                                    F.array(*[F.sum(n) for n in names]).alias("s"),
                                    F.array(*[F.sum(x) for x in pairs]).alias("q"))


def _binned(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the bin of their distance."""
    d = distance(names)
    return rows.withColumn("bin", F.floor(GRID * F.log2(F.greatest(d, F.lit(2.0 ** -20)))).cast("int"))


def _cut(binned: DataFrame, group: list[str], support: float) -> DataFrame:
    """Per group the smallest bin up to which ``support`` of its rows lie."""
    counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*group).orderBy("bin")
    running = counts.withColumn("upto", F.sum("c").over(upto)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(*group)))
    return (running.filter(F.col("upto") >= support * F.col("n")).groupBy(*group)
            .agg(F.min("bin").alias("cut"), F.max("n").alias("n")))


def _on(rows: DataFrame, model: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Join on null-safe group keys.  The model has one row a group and is read from a table,
    so the planner broadcasts it below its size threshold and splits skewed groups beyond."""
    right = model.select(*[F.col(g).alias(f"__{g}") for g in group], *columns)
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    return rows.join(right, same).drop(*[f"__{g}" for g in group])


def _median(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Lower median of ``value`` with multiplicity ``c``, per group."""
    w = Window.partitionBy(*group)
    return (counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("all", F.sum("c").over(w))
            .filter(2 * F.col("upto") >= F.col("all")).groupBy(*group).agg(F.min(value).alias(value)))


def _start(vectors: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Medians and median absolute deviations, each on a grid of 1/START_GRID."""
    cells = vectors.select(*group, F.posexplode(F.array(
        *[F.round(F.col(n) * START_GRID).cast("long") for n in names])).alias("k", "v"))
    counts = materialize(cells.groupBy(*group, "k", "v").agg(F.count("*").alias("c")), "grid")
    centre = materialize(_median(counts, [*group, "k"], "v").withColumnRenamed("v", "m"), "centre")
    away = (_on(counts, centre, [*group, "k"], ["m"]).withColumn("d", F.abs(F.col("v") - F.col("m")))
            .groupBy(*group, "k", "m", "d").agg(F.sum("c").alias("c")))
    x = (_median(away, [*group, "k", "m"], "d").groupBy(*group)
         .agg(F.sort_array(F.collect_list(F.struct("k", "m", "d"))).alias("x")))
    sd = [F.greatest(F.col("x")[i]["d"] * 1.4826 / START_GRID, F.lit(FLOOR[n])) for i, n in enumerate(names)]
    inverse = F.array(*[1 / (sd[i] * sd[i]) if i == j else F.lit(0.0)
                        for i in range(len(names)) for j in range(i, len(names))])
    out = materialize(x.select(*group, F.lit(0).cast("long").alias("n"),
                               F.transform("x", lambda e: e["m"] / START_GRID).alias("mean"),
                               inverse.alias("inverse")), "start")
    discard(counts, centre)
    return out


def fit(vectors: DataFrame, group: list[str], names: list[str], support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """(group..., n, mean, inverse): the estimate of each group from all its rows."""
    model = _start(vectors, group, names)
    for _ in range(steps):
        binned = _binned(_on(vectors, model, group, ["mean", "inverse"]), names).drop("mean", "inverse")
        cut = materialize(_cut(binned, group, support), "cut")
        near = _on(binned, cut, group, ["cut", "n"]).filter("bin <= cut")
        after = materialize(_estimates(_sums(near, group, names), group, names), "mcd")
        discard(model, cut)
        model = after
    return model


def scored(docs: DataFrame, keys: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``keys``, base statistics, ``base_failed``, the vector, and the group as ``__lang`` and ``__source``."""
    marked = docs.withColumn("__lang", F.col(lang)).withColumn("__source", F.col(source))
    return (with_statistics(marked, [*keys, "__lang", "__source"], text)
            .withColumn("base_failed", base_failed()).withColumns(vector()))


def estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """(__lang, __source, mean, inverse): the estimate each group of ``rows`` is judged by."""
    names = list(FLOOR)
    # one estimate a language and source, a language, and all: a row counts in each
    whole = F.lit(None).cast("string")
    level = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("__lang").alias("g_lang"), F.col("__source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("__lang").alias("g_lang"), whole.alias("g_source")),
        F.struct(F.lit(2).alias("level"), whole.alias("g_lang"), whole.alias("g_source"))))
    vectors = rows.filter("NOT base_failed").select(*names, level.alias("g")).select(*names, "g.*")
    model = fit(vectors, ["level", "g_lang", "g_source"], names, support, steps)
    enough = model.filter(F.col("n") >= min_group)
    fine, lang, every = (enough.filter(F.col("level") == k).select(
        F.col("g_lang").alias(f"l{k}"), F.col("g_source").alias(f"s{k}"), F.struct("mean", "inverse").alias(f"e{k}")) for k in range(3))
    groups = rows.select("__lang", "__source").distinct()
    out = materialize(
        groups.join(fine, F.col("__lang").eqNullSafe(F.col("l0")) & F.col("__source").eqNullSafe(F.col("s0")), "left")
        .join(lang, F.col("__lang").eqNullSafe(F.col("l1")), "left")
        .join(F.broadcast(every), F.lit(True), "left")  # at most one row
        .select("__lang", "__source", F.coalesce("e0", "e1", "e2").alias("e"))
        .select("__lang", "__source", "e.mean", "e.inverse"), "chosen")
    discard(model)
    return out


def verdicts(rows: DataFrame, chosen: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` with ``distance`` (null without an estimate) and ``kept``."""
    found = _on(rows, chosen, ["__lang", "__source"], ["mean", "inverse"]).withColumn("distance", distance(list(FLOOR)))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff)))


def keep(docs: DataFrame, cutoff: float = CUTOFF, **parameters) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are no outliers.

    The texts are read twice, for the estimates and for the verdicts, and never shuffled:
    what meets them is one row a group.
    """
    prepare(docs.sparkSession)
    names = [f"__c{i}" for i in range(len(docs.columns))]  # the work columns cannot clash
    place = dict(zip(docs.columns, names))
    renamed = docs.toDF(*names)
    own = {what: place[what] for what in ("lang", "source", "text")}
    chosen = estimates(materialize(scored(renamed, [], **own), "stats"), **parameters)
    return (verdicts(scored(renamed, names, **own), chosen, cutoff).filter("kept")
            .select(*[F.col(n).alias(c) for c, n in place.items()]))


def report(docs: DataFrame, cutoff: float = CUTOFF, **parameters) -> DataFrame:
    """doc_id, base statistics, ``base_failed``, ``distance`` and ``kept`` per row."""
    prepare(docs.sparkSession)
    rows = materialize(scored(docs.select("doc_id", "lang", "source", "text"), ["doc_id"]), "stats")
    found = verdicts(rows, estimates(rows, **parameters), cutoff)
    return found.select("doc_id", *STATS, "base_failed", "distance", "kept")
