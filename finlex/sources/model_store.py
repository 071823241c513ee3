"""Model persistence (S7) and the batch result sink.

A model is a directory of Parquet tables (one per model table) plus a one-row
metadata table carrying classes, features, training metadata, a version and a
timestamp; loading compares versions and reports a mismatch.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_VERSION = "1.0.0"


def save_model(spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    row = {"version": MODEL_VERSION, "saved_at": time.time(), "meta": json.dumps(meta, sort_keys=True)}
    spark.createDataFrame([row], "version STRING, saved_at DOUBLE, meta STRING") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/_metadata_table")


def load_model(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict, list[str]]:
    md = spark.read.parquet(f"{path}/_metadata_table").first()
    warnings = [] if md["version"] == MODEL_VERSION else [
        f"model version {md['version']} differs from engine version {MODEL_VERSION}"]
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return tables, json.loads(md["meta"]), warnings


@dataclass
class LoadedModels:
    """The three models and what scoring needs beside them, read back from tables."""
    type_model: object
    type_vocab: DataFrame
    sentiment_model: object
    sentiment_vocab: DataFrame
    idf: DataFrame
    impact_model: object
    warnings: list[str]


def save_models(spark: SparkSession, path: str, type_p, sentiment_p, impact_p) -> None:
    """The three fitted pipelines' model tables, vocabularies, idf and scaler."""
    t, s, g = type_p.model, sentiment_p.model, impact_p.model
    save_model(spark, f"{path}/type", {"prior": t.prior, "theta": t.theta, "vocab": type_p.vocab},
               {"model": "bernoulli", "classes": t.classes})
    save_model(spark, f"{path}/sentiment", {"weights": s.weights, "vocab": sentiment_p.vocab, "idf": sentiment_p.idf},
               {"model": "complement", "classes": s.classes})
    save_model(spark, f"{path}/impact", {"prior": g.prior, "stats": g.stats, "scaler": g.scaler},
               {"model": "gaussian", "classes": g.classes})


def load_models(spark: SparkSession, path: str) -> LoadedModels:
    from ..operators import naive_bayes as NB
    t, tm, w1 = load_model(spark, f"{path}/type", ["prior", "theta", "vocab"])
    s, sm, w2 = load_model(spark, f"{path}/sentiment", ["weights", "vocab", "idf"])
    g, gm, w3 = load_model(spark, f"{path}/impact", ["prior", "stats", "scaler"])
    return LoadedModels(NB.BernoulliModel(tm["classes"], t["prior"], t["theta"]), t["vocab"],
                        NB.ComplementModel(sm["classes"], s["weights"]), s["vocab"], s["idf"],
                        NB.GaussianModel(gm["classes"], g["prior"], g["stats"], g["scaler"]), w1 + w2 + w3)


def batch_results(processed: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Per document has_error, has_warnings, num_features, metadata, derived metadata."""
    nf = sum((F.col(c).isNotNull().cast("int") for c in feature_cols), F.lit(0))
    return processed.select("doc_id", F.col("error_code").isNotNull().alias("has_error"),
                            (F.coalesce(F.size("warnings"), F.lit(0)) > 0).alias("has_warnings"),
                            nf.cast("bigint").alias("num_features"), "metadata", "derived_metadata")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
