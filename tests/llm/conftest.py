import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample_texts():
    con = duckdb.connect()
    return [r[0] for r in con.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) tuples, with a clashing extra column."""
    def make(rows):
        rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        schema = "doc_id long, text string, lang string, source string"
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F
        return (df.withColumn("n_chars", F.length("text").cast("long")).withColumn("fingerprint", F.lit("x"))
                .withColumn("n_tokens", F.lit(1)).withColumn("mean", F.lit(0.0)))
    return make
