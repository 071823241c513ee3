"""Shuffled shards by a two-pass external shuffle (operator 13).

Pass one scatters the records over buckets by seeded hashes, through one Spark shuffle;
a bucket is sized to fit a task's memory (``BUCKET_BYTES`` of text).  Pass two reads each
bucket whole, puts it in a canonical order, shuffles it by Fisher and Yates with a
generator seeded by (seed, bucket), and writes it as one file of its shard.  So a shard's
order is a seeded random one at any size, and a repeated task writes the same rows.

Law ``key``: the shard follows from ``doc_id``, the seed and the number of shards alone.
Shard ``j`` takes a row when the row's ``j``-th hash is divisible by ``j + 1`` and no
later shard takes it; a further shard only asks one more hash, so rows move into the new
shard and nowhere else.

Sizing: one aggregate over (shard, row hash) gives the bytes of each shard, hence its
number of buckets, so a shard that holds a third of all rows gets a third of the buckets.
Rows of one ``doc_id`` or text fall into different buckets of their shard unless they are
equal in both; equal rows that would fill a good part of a bucket are dealt by position
(they cannot be told apart, and the law asks only for their shard).

Defined cases: a null text is empty (size 1, crc of nothing), a null ``doc_id`` is a key
like any other; repeated rows each keep their place; an empty table gives an empty result;
other columns are kept by ``write`` except those with its names, and not read by ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, shared_path

SHARDS = 8
SEED = 1
BUCKET_BYTES = 32 << 20
# Lists of buckets (16 bytes each) are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_BUCKETS = 1 << 20
OUT_ROWS = 512
OWN = ("shard", "bucket", "place")


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The last shard whose hash of the key takes it; shard 0 takes what is left."""
    numbers = F.sequence(F.lit(1), F.lit(shards - 1)) if shards > 1 else F.array().cast("array<int>")
    takes = F.filter(numbers, lambda j: F.pmod(F.xxhash64(F.lit(seed), j, doc_id), j + 1) == 0)
    return F.coalesce(F.array_max(takes), F.lit(0)).cast("int")


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    """A random order of 0 to n - 1: each place, from the last, swaps with one at or before it."""
    order = list(range(n))
    if n > 1:
        for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist()):
            order[i], order[j] = order[j], order[i]
    return order


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _plan(rows: DataFrame, shards: int, bucket_bytes: int) -> tuple[list[int], int]:
    """Buckets of each shard, and the most bytes of equal rows."""
    repeated = F.when(F.col("n") > 1, F.col("size")).otherwise(0)
    # one row a shard
    found = {r.shard: r for r in _per_hash(rows).groupBy("shard")
             .agg(F.sum("size").alias("size"), F.max(repeated).alias("repeated")).collect()}
    counts = [max(1, -(-found[s].size // bucket_bytes)) if s in found else 1 for s in range(shards)]
    return counts, max((r.repeated for r in found.values()), default=0)


def _per_hash(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard", "__h").agg(F.count("*").alias("n"), F.sum("__size").alias("size"))


def write(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
          path: str | None = None) -> DataFrame:
    """Write the shards as Parquet (``shard=k`` folders, one file a bucket) and return the written table.

    Columns: shard, bucket, place (in the bucket, from 0), doc_id, then the other columns of
    ``docs``.  A shard's order is that of (bucket, place).  ``path`` must not exist; by default it
    is a new one under the shared folder, which the caller deletes when done.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or shared_path(spark, "shuffled")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       *[c for c in docs.columns if c.lower() not in ("doc_id", "__h", "__size", *OWN)])
    rows = kept.select("*", shard_of(F.col("doc_id"), shards, seed).alias("shard"), size_of(F.col("text")).alias("__size"),
                       F.xxhash64(F.lit(seed), "doc_id", "text").alias("__h"))
    slim = rows.select("shard", "__h", "__size")
    counts, most_equal = _plan(slim, shards, bucket_bytes)
    first = np.concatenate(([0], np.cumsum(counts))).tolist()
    total = first[-1]
    spread = F.xxhash64(F.lit(seed), F.col("__h"))
    if most_equal > bucket_bytes // 4:  # fewer than four such hashes a bucket
        hot = (_per_hash(slim).filter((F.col("n") > 1) & (F.col("size") > bucket_bytes // 4))
               .select("shard", "__h", F.lit(True).alias("__hot")))
        rows = rows.join(F.broadcast(hot) if total <= BROADCAST_BUCKETS else hot, ["shard", "__h"], "left")
        spread = F.when(F.col("__hot"), F.xxhash64(F.lit(seed), F.col("__h"), F.monotonically_increasing_id())).otherwise(spread)
    by_shard = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("shard") + 1)
    bucket = (by_shard(first[:-1]) + F.pmod(spread, by_shard(counts))).cast("int")
    scattered = rows.select("shard", bucket.alias("bucket"), *kept.columns).repartitionById(total, F.col("bucket"))

    schema = T.StructType([*T.StructType.fromDDL("shard int, bucket int, place long").fields, *kept.schema.fields])
    names = [f.name for f in schema.fields]
    at_text = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        number = t.column("bucket")[0].as_py()  # a partition is a bucket
        data = t.select(list(range(2, t.num_columns)))
        keys = pa.table({"k": data.column(0), "t": data.column(at_text)})
        order = pc.sort_indices(keys, sort_keys=[("k", "ascending"), ("t", "ascending")]).to_numpy()
        order = order[fisher_yates(len(order), np.random.Generator(np.random.PCG64([seed, number])))]
        for a in range(0, len(order), OUT_ROWS):
            part = data.take(pa.array(order[a:a + OUT_ROWS])).combine_chunks()
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [t.column("shard").slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))),
                 pa.array(np.full(n, number, np.int32)), pa.array(np.arange(a, a + n)),
                 *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in part.columns]], names)

    out = scattered.mapInArrow(run, schema)
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def places(written: DataFrame) -> DataFrame:
    """``written`` with slot, the place in the shard: gapless from 0."""
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("__n"))
    # one row a bucket of at most BUCKET_BYTES or so, in one list a shard
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("__n").over(
        Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    if sizes.count() <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    return (written.join(starts, ["shard", "bucket"])
            .select(*written.columns, (F.col("__start") + F.col("place")).alias("slot")))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document, read back from the written files."""
    at = places(write(docs.select("doc_id", "text"), shards, seed))
    return at.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                     F.lit("key").alias("law"), "shard", "slot",
                     shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"))
