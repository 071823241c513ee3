"""Vocabulary and term vectors (X1-X7) in long form.

* The vocabulary is one aggregation keyed by term, partially aggregated in
  the task, so a Zipfian head term costs one row per partition, not one per
  occurrence.  It is capped by ``max_features``, which bounds every later
  broadcast of it.
* Term counts read the texts again and keep the vocabulary's terms only, as one
  row of positions and counts a document, written once: no shuffle carries text
  or n-grams.  Fits and scores sum over these rows in the task; the long form is
  spread out of them only where it is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import grams as GR
from ..session import materialize


@dataclass(frozen=True)
class VocabConfig:
    ngram_min: int = 1
    ngram_max: int = 2
    min_df: int = 2
    max_features: int = 1000
    min_token_chars: int = 2  # scikit-learn's default token pattern keeps \w\w+


# The words that a vocabulary's longer n-grams can be made of are handed to the tasks up to so many (a few MB).
WORDS_HELD = 200_000

TYPE_VOCAB = VocabConfig(1, 2, 2, 1000)
SENTIMENT_VOCAB = VocabConfig(1, 3, 3, 5000)


def fit_vocabulary(docs: DataFrame, norm_col: str, cfg: VocabConfig) -> DataFrame:
    """``(term, idx, df, tf)``; ``min_df`` first, then the ``max_features``
    most frequent terms (ties by term); ``idx`` is the alphabetical position.

    A document's n-grams count for ``tf``, its distinct ones for ``df``; both are summed per term in
    the task, so a head term costs one row a task.  Words are counted first.  No n-gram is more
    frequent than its words, and at least as many terms as there are words above it are before the
    last of the ``max_features`` most frequent words: longer n-grams are only counted of words as
    frequent as that one, which leaves none out.  Where these words are too many to hand out, all
    n-grams are counted.
    """
    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter(F.col("df") >= cfg.min_df)

    def counts(lo: int, hi: int, words: list[str] | None = None) -> DataFrame:
        return summed(GR.gram_counts(docs, norm_col, lo, hi, cfg.min_token_chars, words))

    first = [F.col("tf").desc(), F.col("term")]
    stats = counts(cfg.ngram_min, cfg.ngram_max) if cfg.ngram_max == 1 else None
    if stats is None:
        words = materialize(counts(1, 1), "words")
        top = words.orderBy(*first).limit(cfg.max_features).agg(F.min("tf").alias("tf"), F.count(F.lit(1)).alias("n")).first()
        least = top["tf"] if cfg.ngram_min == 1 and top["n"] == cfg.max_features else 0
        found = [r.term for r in words.filter(F.col("tf") >= least).select("term").limit(WORDS_HELD + 1).collect()]
        if len(found) > WORDS_HELD or not GR.numbered(max(1, len(found)), cfg.ngram_max):
            stats = counts(cfg.ngram_min, cfg.ngram_max)
        else:
            longer = counts(max(2, cfg.ngram_min), cfg.ngram_max, sorted(found))
            stats = words.unionByName(longer) if cfg.ngram_min == 1 else longer
    top = stats.orderBy(*first).limit(cfg.max_features)
    # the capped vocabulary is small: a single ordered partition gives the index
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint")) \
        .select("term", "idx", "df", "tf")


@dataclass
class TermVectors:
    """The vocabulary's terms of each document as one row of positions and counts (``grams.PACKED``)."""
    given: DataFrame         # (doc_id, *keep, positions and counts), a row an input row
    rows: DataFrame          # the same, a row a (doc_id, *keep)
    terms: list[str]
    keep: tuple[str, ...]
    repeated: bool           # a doc_id may have several rows

    def filter(self, condition: Column) -> TermVectors:
        return replace(self, given=self.given.filter(condition), rows=self.rows.filter(condition))

    def long(self) -> DataFrame:
        """``(doc_id, *keep, term, idx, n)``."""
        e = GR.unpack(self.rows, ("doc_id", *self.keep), len(self.terms)).select("doc_id", *self.keep, F.inline(F.arrays_zip("idx", "n")))
        return e.select("doc_id", *self.keep, GR.term_of(self.terms, "idx").alias("term"), F.col("idx").cast("bigint").alias("idx"), "n")

    def present(self) -> TermRows | DataFrame:
        """X2 as weights: one for each term a document has."""
        return self.long() if self.repeated else TermRows(self.rows, self.terms, self.keep)


@dataclass
class TermRows:
    """Weights of documents' terms, a row a document: sums over them make no row a term.

    Only of documents that have one row each (a doc_id of several rows takes the long form).  With
    ``idf`` the weights are X4's, without it one for each term.  ``numeric`` columns beside the terms
    are terms of their own (X6), named after ``#``; a zero is none.
    """
    rows: DataFrame          # (doc_id, *keep, positions and counts, *numeric)
    terms: list[str]
    keep: tuple[str, ...]
    idf: list[float] | None = None
    numeric: tuple[str, ...] = ()

    def filter(self, condition: Column) -> TermRows:
        return replace(self, rows=self.rows.filter(condition))

    def drop(self, *cols: str) -> TermRows:
        return replace(self, keep=tuple(c for c in self.keep if c not in cols))

    def long(self) -> DataFrame:
        """``(doc_id, *keep, term, w)``."""
        vec = TermVectors(self.rows, self.rows, self.terms, self.keep, False)
        text = vec.long().withColumn("w", F.lit(1.0)) if self.idf is None else _weights_long(vec, self.idf)
        if not self.numeric:
            return text.select("doc_id", *self.keep, "term", "w")
        both = union_rows(text, self.rows, list(self.numeric), self.keep)
        return both.filter("w > 0").withColumn("w", F.lit(1.0)) if self.idf is None else both

    def names(self) -> list[str]:
        return [*self.terms, *(f"#{n}" for n in self.numeric)]

    def label_sums(self) -> DataFrame:
        """``(label, term, x)``: the weights of a label's documents added up; summed in the task, so a row a term, label and task is shuffled."""
        s = GR.weight_sums(self.rows, "label", len(self.terms), self.idf, self.numeric).groupBy("label", "idx").agg(F.sum("x").alias("x"))
        return s.select("label", GR.term_of(self.names(), "idx").alias("term"), "x")

    def products(self, per_term: list[dict[str, float]], base: list[float]) -> DataFrame:
        """``(doc_id, *keep, _s0, ...)``: for each of ``per_term`` its base and the sum of weight times value; in the row."""
        table = np.array([[of.get(t, 0.0) or 0.0 for of in per_term] for t in self.names()], dtype=np.float64).reshape(-1, len(per_term))
        return GR.weight_products(self.rows, ("doc_id", *self.keep), table, base, len(self.terms), self.idf, self.numeric)


def vectorize(docs: DataFrame, norm_col: str, vocab: DataFrame, cfg: VocabConfig, keep: tuple[str, ...] = ()) -> TermVectors:
    """The documents' vectors over the vocabulary (bounded by ``max_features``), written once.

    Narrow: other n-grams are gone and repeats are counted in the row's own task.  Only rows whose
    doc_id comes again are shuffled and added up.
    """
    terms = [r.term for r in vocab.orderBy("idx").select("term").collect()]
    key = ("doc_id", *keep)
    given = materialize(GR.vocabulary_hits(docs, norm_col, key, terms, cfg.ngram_min, cfg.ngram_max, cfg.min_token_chars), "terms")
    again = given.groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_d")
    if again.isEmpty():
        return TermVectors(given, given, terms, keep, False)
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    summed = (GR.unpack(given.join(again, same, "left_semi"), key, len(terms)).select(*key, F.inline(F.arrays_zip("idx", "n")))
              .groupBy(*key, "idx").agg(F.sum("n").alias("n"))
              .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("_p"))
              .select(*key, F.col("_p.idx").alias("idx"), F.col("_p.n").alias("n")))
    rows = given.join(again, same, "left_anti").unionByName(GR.pack(summed, key, len(terms)))
    return TermVectors(given, materialize(rows, "terms"), terms, keep, True)


def idf_table(vec: DataFrame | TermVectors, n_docs: Column | int, vocab: DataFrame) -> DataFrame:
    """X4 idf per term: ln((1+n)/(1+df)) + 1 (smooth idf), df over ``vec``."""
    if isinstance(vec, TermVectors):
        df = GR.weight_sums(vec.rows, None, len(vec.terms)).groupBy("idx").agg(F.sum("n").alias("dfv")) \
            .select(GR.term_of(vec.terms, "idx").alias("term"), "dfv")
    else:
        df = vec.groupBy("term").agg(F.count(F.lit(1)).alias("dfv"))
    return (vocab.select("term", "idx").join(df, "term", "left")
            .select("term", "idx", (F.log((F.lit(1) + F.lit(n_docs)) / (F.lit(1) + F.coalesce("dfv", F.lit(0))))
                                   + 1.0).alias("idf")))


def _idf_of(vec: TermVectors, idf: DataFrame) -> list[float]:
    of = {r.idx: r.idf for r in idf.collect()}  # bounded by max_features
    return [of.get(i, 0.0) for i in range(len(vec.terms))]


def tfidf(vec: TermVectors, idf: DataFrame) -> DataFrame:
    """Tf * idf, each document's row L2-normalised: ``(doc_id, *keep, term, idx, w)``.

    The norm is taken in the document's row; only where a doc_id has several rows it is a window over them.
    """
    return _weights_long(vec, _idf_of(vec, idf))


def _weights_long(vec: TermVectors, idf: list[float]) -> DataFrame:
    w = GR.weighted(vec.rows, ("doc_id", *vec.keep), idf)
    norm = F.sqrt(F.sum("sq").over(Window.partitionBy("doc_id")) if vec.repeated else F.col("sq"))
    e = w.select("doc_id", *vec.keep, "idx", "w", norm.alias("_norm")).select("doc_id", *vec.keep, "_norm", F.inline(F.arrays_zip("idx", "w")))
    return e.select("doc_id", *vec.keep, GR.term_of(vec.terms, "idx").alias("term"), F.col("idx").cast("bigint").alias("idx"),
                    (F.col("w") / F.col("_norm")).alias("w"))


def tfidf_rows(vec: TermVectors, idf: DataFrame) -> TermRows | DataFrame:
    """X4 for sums over the weights: a row a document, the long form where a doc_id has several rows."""
    return tfidf(vec, idf) if vec.repeated else TermRows(vec.rows, vec.terms, vec.keep, _idf_of(vec, idf))


def weight_profile(weights: TermRows | DataFrame) -> DataFrame:
    """``(doc_id, nnz, max_w, sq_norm)`` of every document that has a term."""
    if isinstance(weights, TermRows):
        return GR.weight_profile(weights.rows, len(weights.terms), weights.idf)
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.max("w").alias("max_w"), F.sum(F.col("w") * F.col("w")).alias("sq_norm"))


def align_features(df: DataFrame, trained: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Select the trained feature schema by name; missing -> 0.0, extra dropped."""
    have = set(df.columns)
    cols = [F.col(k) for k in keep]
    for name in trained:
        cols.append((F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)).alias(name))
    return df.select(*cols)


def assemble(df: DataFrame, vector_col: str | None, numeric_cols: list[str], out: str = "features") -> DataFrame:
    """Text vector + numeric feature columns into one ML vector."""
    from pyspark.ml.feature import VectorAssembler
    inputs = ([vector_col] if vector_col else []) + numeric_cols
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error").transform(df)


def union_rows(text_rows: DataFrame | TermRows, wide: DataFrame, numeric: list[str], keep: tuple[str, ...] = ()) -> DataFrame | TermRows:
    """X6 in long form, the input of the text models: (doc_id, *keep, term, w) of text terms and numeric features.

    ``text_rows``: (doc_id, *keep, term, w); ``wide``: one column a feature, aligned by name
    (X7: a missing one is zero).  A feature's term is its name after ``#``, which no n-gram
    holds; zeros are left out, as in a sparse row.  ``TermRows`` carry the numeric features as columns
    of their own rows, which then stay a row a document.
    """
    if isinstance(text_rows, TermRows):
        rows = text_rows.rows
        of = [(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0)).alias(n) for n in numeric]
        return replace(text_rows, rows=rows.select("doc_id", *text_rows.keep, *GR.PACKED, *of), numeric=tuple(numeric))
    aligned = align_features(wide, numeric, ("doc_id", *keep))
    rows = aligned.unpivot(["doc_id", *keep], numeric, "term", "w").filter(F.col("w") != 0)
    return text_rows.select("doc_id", *keep, "term", F.col("w").cast("double").alias("w")).unionByName(
        rows.select("doc_id", *keep, F.concat(F.lit("#"), "term").alias("term"), "w"))


def union_vocabulary(vocab: DataFrame, numeric: list[str]) -> DataFrame:
    """The vocabulary's terms and the numeric features', ``(term)``."""
    names = vocab.sparkSession.createDataFrame([(f"#{n}",) for n in numeric], "term STRING")
    return vocab.select("term").unionByName(names)


def sparse_vectors(vec: TermVectors, idf: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_vector)`` as sparse vectors of counts, or of L2-normalised TF-IDF with ``idf``.

    A document's positions and counts are the vector; written once, as learners read it again and again.
    """
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors, VectorUDT
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(len(vec.terms)).alias("size"),
                      F.col("idx").alias("indices"), F.col("n").cast("array<double>").alias("values"))
    rows = GR.unpack(vec.given, ("doc_id",), len(vec.terms)).select("doc_id", vector.alias("_tf"))
    out = materialize(rows, "vectors", StructType([rows.schema["doc_id"], StructField("_tf", VectorUDT())]))
    if idf is None:
        return out.select("doc_id", F.col("_tf").alias("text_vector"))
    weights = {r.term: r.idf for r in idf.collect()}
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([weights[t] for t in vec.terms]), inputCol="_tf", outputCol="_w").transform(out)
    return Normalizer(p=2.0, inputCol="_w", outputCol="text_vector").transform(scaled).select("doc_id", "text_vector")


# ---------------------------------------------------------------- X8 registry

VECTORIZERS: dict[str, object] = {}
EXTRACTORS: dict[str, object] = {}


def register_vectorizer(name: str, fn) -> None:
    """A vectoriser is ``DataFrame -> DataFrame`` producing long term rows."""
    VECTORIZERS[name] = fn


def register_extractor(name: str, fn) -> None:
    """An extractor returns ``dict[name, Column]`` (or wraps a pandas UDF)."""
    EXTRACTORS[name] = fn
