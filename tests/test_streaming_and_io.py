"""Stream equals batch; lexicon round trip; edge cases; large-lexicon path."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finlex.functions import text as TX
from finlex.functions import validate as V
from finlex.plans import QUERIES
from finlex.sources import fixtures as FX
from finlex.sources import lexicon as LX
from finlex.plans.q_stream import EVENT_SCHEMA
from finlex.streaming import stream as ST
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    streamed = QUERIES["R1_document_stream"](spark, SF_SMALL)
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    v = V.validate_documents(d.select("doc_id", "text"))
    batch = v.select("doc_id", "error_code", F.size(TX.words(TX.normalize("clean_text"))).cast("bigint")
                     .alias("word_count"))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_lexicon_roundtrip(spark):
    out = QUERIES["S3_S4_lexicon_roundtrip"](spark, SF_SMALL)
    a = out.filter("name = 'from_json'").select("category", "term", "ord")
    b = out.filter("name = 'from_csv'").select("category", "term", "ord")
    assert a.count() > 50 and a.exceptAll(b).count() == 0


def test_lexicon_scan_counts_like_str_count(spark):
    words = {"positive": ["the", "que", "und", "aa"], "negative": ["los", "die", "les"], "neutral": ["and", "des", "von", "de"]}
    rows = [("t", c, w, i) for c, ws in words.items() for i, w in enumerate(ws)]
    lex = spark.createDataFrame(rows, LX.LEXICON_SCHEMA)
    docs = spark.createDataFrame([(1, "the theory and aaaaa"), (2, None), (3, ""), (4, "des und los de")], "doc_id BIGINT, st STRING")
    got = {r.doc_id: r for r in LX.lexicon_counts(docs, "st", lex).collect()}
    for k, t in ((1, "the theory and aaaaa"), (2, ""), (3, ""), (4, "des und los de")):
        for c, ws in words.items():
            assert got[k][f"{c}_terms_count"] == sum(t.count(w) for w in ws)


def test_a_lexicon_beyond_a_worker_is_refused(spark, monkeypatch):
    monkeypatch.setattr(LX, "LEXICON_BYTES", 10)
    docs = spark.createDataFrame([(1, "x")], "doc_id BIGINT, st STRING")
    with pytest.raises(ValueError, match="lexicon"):
        LX.lexicon_counts(docs, "st", LX.default_lexicon(spark))


def _files(spark, df, path, n):
    """``df`` as n Parquet files."""
    for k in range(n):
        df.filter(F.pmod(F.col(df.columns[0]), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def test_history_over_several_batches_is_the_last_n_per_user(spark, tmp_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("user_id % 7 = 0")
    src = _files(spark, ev, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    ST.run_history(ST.table_stream(spark, src, EVENT_SCHEMA), out, 5).awaitTermination()
    got = ST.current_history(spark, out)
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    want = ev.withColumn("rn", rn).filter("rn <= 5").select("user_id", "ts", "event_id", "event_type")
    got = got.select(*want.columns)
    assert spark.read.parquet(f"{out}/history").select("batch_id").distinct().count() == 3
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path, parts):
    spark.range(30).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")) \
        .repartition(parts).write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.range(5).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")).write.parquet(str(tmp_path / "in/other.parquet"))
    out = str(tmp_path / "out")
    ST.run_batches(ST.table_stream(spark, str(tmp_path / "in"), "doc_id BIGINT, text STRING", "documents.parquet"),
                   lambda b: b, out).awaitTermination()
    assert spark.read.parquet(f"{out}/results").groupBy("text").count().collect() == [("text", 30)]


def test_a_failing_batch_goes_to_quarantine_and_the_stream_goes_on(spark, tmp_path):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    src = _files(spark, docs, str(tmp_path / "in"), 3)
    seen = []

    def process(batch):
        if not batch.filter("doc_id = 4").isEmpty():
            raise ValueError("bad batch")
        return batch.withColumn("error_code", F.lit(None).cast("string"))

    for _ in range(2):  # the second run finds all offsets committed and adds nothing
        ST.run_batches(ST.table_stream(spark, src, "doc_id BIGINT, text STRING"), process, str(tmp_path / "out"),
                       callback=lambda df, b: seen.append((b, df.count()))).awaitTermination()
    s = ST.stream_statistics(spark, str(tmp_path / "out")).first()
    assert (s.batches, s.texts, s.errors) == (3, 30, 10)
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 20 == sum(n for _, n in seen)
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 10


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """A restart after the sink but before the commit runs the batch again."""
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    src = _files(spark, docs, str(tmp_path / "in"), 1)
    out = tmp_path / "out"
    run = lambda: ST.run_batches(ST.table_stream(spark, src, "doc_id BIGINT, text STRING"), lambda b: b, str(out)).awaitTermination()
    run()
    for f in (out / "_checkpoint" / "commits").glob("*0*"):
        f.unlink()
    run()
    assert spark.read.parquet(str(out / "results")).count() == 10
    assert ST.stream_statistics(spark, str(out)).first().texts == 10


def test_edge_cases_do_not_fail(spark):
    e = FX.edge_cases(spark)
    clean, err = V.validate_text("text")
    r = {x.case_id: x for x in e.select("case_id", err.alias("err"), TX.normalize(clean).alias("n")).collect()}
    assert r[1].err == "TEXT_TOO_SHORT" and r[2].err == "NULL_TEXT"
    assert r[7].err is None and r[3].n == "12345" and len(r[4].n) == 1_000_000
