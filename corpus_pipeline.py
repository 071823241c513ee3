"""Documents to packed training sequences: quality rules, near-duplicates, benchmark
passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its
result is written as Parquet and reread as the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlex.llm import packing, pii_crf, robust_outliers, simhash_pigeonring, wordpiece_count, wu_manber
from finlex.llm.common import materialize, prepare
from finlex.llm.queries import tokenizer_file
from finlex.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are outliers of their language and source."""
    return robust_outliers.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash_pigeonring.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item."""
    return wu_manber.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii_crf.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document's pieces in training sequences of 2048 tokens."""
    return packing.report(docs, pieces=wordpiece_count.vocabulary(tokenizer_file("piece_bpe_32k.model")))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packed)]

# The outlier estimates, fingerprints and packing have no SQL form; tests/llm compare
# the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
