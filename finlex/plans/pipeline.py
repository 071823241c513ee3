"""Pipeline composition, selective processing, compute-once reuse.

A pipeline is an ordered list of named ``DataFrame -> DataFrame`` steps applied
with ``DataFrame.transform``; the whole pipeline is one lazy plan, so Catalyst
prunes columns that no later step or output needs (T13).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as EN
from ..functions import features as FE
from ..functions import text as TX

Step = Callable[[DataFrame], DataFrame]


@dataclass
class PipelineStep:
    step_id: str
    fn: Step
    enabled: bool = True


@dataclass
class Pipeline:
    """Ordered named steps; add (replace in place on the same id), remove, get."""
    steps: list[PipelineStep] = field(default_factory=list)

    def add_step(self, step_id: str, fn: Step, enabled: bool = True) -> Pipeline:
        for i, s in enumerate(self.steps):
            if s.step_id == step_id:
                self.steps[i] = PipelineStep(step_id, fn, enabled)
                return self
        self.steps.append(PipelineStep(step_id, fn, enabled))
        return self

    def remove_step(self, step_id: str) -> bool:
        before = len(self.steps)
        self.steps = [s for s in self.steps if s.step_id != step_id]
        return len(self.steps) < before

    def get_step(self, step_id: str) -> PipelineStep | None:
        return next((s for s in self.steps if s.step_id == step_id), None)

    def process(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            if s.enabled:
                df = df.transform(s.fn)
        return df


def _normalise(variant: str = "type") -> Step:
    return lambda df: df.withColumn("normalized_text", TX.normalize_variant("text", variant))


def _tokenise(df: DataFrame) -> DataFrame:
    w = df.withColumn("words", TX.words("normalized_text")).withColumn("sentences", TX.sentences("text"))
    return w


def _entities(df: DataFrame) -> DataFrame:
    return df.withColumn("entities", EN.entities("text", "words"))


def _features(df: DataFrame) -> DataFrame:
    f = FE.compose(FE.coarse_type_flags("normalized_text"), FE.coarse_sentiment("normalized_text"))
    return df.withColumns(f)


def _metadata(df: DataFrame) -> DataFrame:
    return df.withColumn("derived_metadata", TX.derived_metadata("normalized_text", "words", "sentences"))


def default_pipeline(variant: str = "type") -> Pipeline:
    """normalise -> tokenise -> entities -> features -> metadata."""
    return (Pipeline().add_step("normalizer", _normalise(variant)).add_step("tokenizer", _tokenise)
            .add_step("entity_extractor", _entities).add_step("feature_extractor", _features)
            .add_step("metadata_enricher", _metadata))


def with_step_errors(df: DataFrame, checks: dict[str, Column], stop_on_error: bool = False) -> DataFrame:
    """Per-document warnings ``STEP_ERROR_<ID>`` for failed step checks; with
    ``stop_on_error`` the first failure becomes the row's ``error_code``."""
    warns = F.array_compact(F.array(*[F.when(~c, F.lit(f"STEP_ERROR_{k.upper()}")) for k, c in checks.items()]))
    out = df.withColumn("warnings", warns)
    if stop_on_error:
        out = out.withColumn("error_code", F.try_element_at("warnings", F.lit(1)))
    return out


def observed_stats(df: DataFrame, name: str = "pipeline_stats"):
    """Processed / error / warning counts collected with ``observe`` while
    the result is written (no extra pass)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    o = df.observe(obs, F.count(F.lit(1)).alias("processed"),
                   F.count_if(F.col("error_code").isNotNull()).alias("errors"),
                   F.count_if(F.size("warnings") > 0).alias("with_warnings"))
    return o, obs


def select_requirements(df: DataFrame, normalize: bool = True, tokenize: bool = True,
                        features: tuple[str, ...] = ("type", "sentiment", "impact")) -> DataFrame:
    """Build only the requested outputs; unrequested work never enters the plan."""
    cols = [F.col("doc_id")]
    if normalize:
        cols.append(TX.normalize("text").alias("normalized_text"))
    if tokenize:
        cols.append(TX.words(TX.normalize("text")).alias("words"))
    groups = {"type": lambda: FE.type_indicators(TX.normalize_variant("text", "type")),
              "sentiment": lambda: FE.lexicon_features(TX.normalize_variant("text", "sentiment")),
              "impact": lambda: FE.numeric_features(TX.normalize_variant("text", "impact"))}
    for g in features:
        cols.extend(c.alias(k) for k, c in groups[g]().items())
    return df.select(*cols)


def compute_once(df: DataFrame, heavy: Step, text_col: str = "text", config_key: str = "") -> DataFrame:
    """Run ``heavy`` once per distinct (md5(text), config) and join back.

    ``heavy`` maps ``(key, text)`` rows to ``(key, ...)`` results.  The distinct
    keeps text out of the join-back (only the key travels with the documents).
    """
    keyed = df.withColumn("_key", F.md5(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u0001" + config_key))))
    uniq = keyed.select("_key", text_col).dropDuplicates(["_key"])
    res = heavy(uniq).drop(text_col)
    return keyed.drop(text_col).join(res, "_key").drop("_key")


def reuse_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Hits, misses, hit rate, characters saved by computing once per text."""
    k = df.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("k"), F.length(text_col).alias("n"))
    per = k.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    return per.agg(F.sum("c").alias("requests"), F.count(F.lit(1)).alias("misses"),
                   (F.sum("c") - F.count(F.lit(1))).alias("hits"),
                   F.sum((F.col("c") - 1) * F.col("n")).alias("chars_saved")) \
        .withColumn("hit_rate", F.col("hits") / F.col("requests"))


def remove_stopwords(words: str | Column, language: str = "portuguese") -> Column:
    """T3 (declared in the reference): drop Spark's stop words for ``language``."""
    from pyspark.ml.feature import StopWordsRemover
    stop = StopWordsRemover.loadDefaultStopWords(language)
    arr = F.array(*[F.lit(s) for s in stop])
    return F.filter(TX._c(words), lambda w: ~F.array_contains(arr, w))


def lemmatize(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Lemma dictionary ``(form, lemma)`` applied by a broadcast left join on long tokens."""
    return tokens.join(F.broadcast(lemmas), tokens.term == lemmas.form, "left") \
        .withColumn("term", F.coalesce("lemma", "term")).drop("form", "lemma")


def batched(df: DataFrame, batch_size: int) -> DataFrame:
    """Fixed-size batches in input order (``batch_id``).

    ``zipWithIndex`` numbers rows partition by partition (one small job counts
    the partitions), so no single task sees all rows, unlike a global window.
    """
    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType(df.schema.fields + [StructField("_idx", LongType(), False)])
    idx = df.rdd.zipWithIndex().map(lambda ri: tuple(ri[0]) + (ri[1],)).toDF(schema)
    return idx.withColumn("batch_id", (F.col("_idx") / batch_size).cast("long")).drop("_idx")


def for_each_result(df: DataFrame, callback: Callable) -> None:
    """Per-result callback, run on executors partition by partition."""
    df.foreachPartition(lambda rows: [callback(r) for r in rows])
