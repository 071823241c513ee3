"""Document and training sources.

Every reader names the columns it needs so Parquet column pruning happens at the
scan; filters written downstream are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one provided Parquet table, optionally projecting ``cols``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def documents(spark: SparkSession, sf_dir: str, with_metadata: bool = False) -> DataFrame:
    """Documents as ``(doc_id, text[, metadata MAP<STRING,STRING>])``.

    Metadata is carried as a map built from the document's own columns; it is
    attached by key, never zipped by position.
    """
    df = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    if not with_metadata:
        return df.select("doc_id", "text")
    return df.select(
        "doc_id", "text",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
    )


def attach_metadata(docs: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """S1 metadata join: left join on the key; missing metadata becomes ``{}``."""
    empty = F.create_map().cast("map<string,string>")
    return (docs.join(metadata.select(key, F.col("metadata").alias("_md")), key, "left")
            .withColumn("metadata", F.coalesce(F.col("_md"), empty)).drop("_md"))


def labelled_documents(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Training source, documents joined with labels on ``doc_id``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", label)
    return docs.join(labels, "doc_id").withColumnRenamed(label, "label") \
        .withColumn("label", F.col("label").cast("string"))


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))
