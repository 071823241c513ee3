"""SimHash near-duplicates with pigeonring candidate filtering (operator 7).

Fingerprint: the text's A-Z is lower-cased, words are runs of anything but ASCII white
space, shingles are ``k`` consecutive words (repeats count, fewer words make one shingle),
and a bit is set when over half the shingles' XXH64 (seed 42) have it.  Equal fingerprints
collapse first, so exact copies cost nothing later.

Candidates: the fingerprint's ``segments`` (m) segments stand in a ring.  If two
fingerprints differ in at most t bits, then from some segment on every chain of l
consecutive segments differs in at most ``l * t // m`` bits (pigeonring principle).  The
budgets of the first segments are zero, so that run of segments is an equality key; the
rest of the chain prunes the pairs of a bucket before the full Hamming check.  A bucket of
more than ``bucket_rows`` fingerprints is never paired: there each fingerprint lists its
variants within ceil(t / 2) bits outside the key, and two within t bits meet in a common
variant, whose group is bounded by the number of such variants.

Components: large-star / small-star contraction over links between distinct fingerprints.

Defined cases: null and word-free texts have fingerprint zero and link like any other;
repeated rows share a fingerprint; a row with null ``doc_id`` never names a component: its
component is that of the documents with its fingerprint's links, or null without any; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, so other columns
cannot clash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_lookup, map_arrow, materialize, prepare, text_bytes

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 7
BUCKET_ROWS = 256
_BLOCK = 1 << 15


def fingerprint(data: bytes, k: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    k = min(k, len(words))
    h = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    starts = itertools.chain((0,), ends)
    spans = zip(starts, ends[k - 1:])
    while block := [h(joined[a:b - 1], SEED) for a, b in itertools.islice(spans, _BLOCK)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint's 64 bits as a long."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, k) for x in text_bytes(b.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch, "doc_id long, fp long")


def segment_masks(m: int) -> list[int]:
    cuts = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_run(m: int, t: int) -> int:
    """Number of leading segments of a chain whose budget is zero."""
    return (m - 1) // t if t else m


def chain_links(fps: np.ndarray, start: int | None, m: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``t`` bits; with ``start``, only along the chain that begins there."""
    i, j = np.triu_indices(len(fps), 1)
    d = fps[i] ^ fps[j]
    if start is not None:
        masks = np.array(segment_masks(m), np.uint64)
        spent = np.zeros(len(d), np.int64)
        for l in range(1, m + 1):
            spent += np.bitwise_count(d & masks[(start + l - 1) % m])
            keep = spent <= l * t // m
            i, j, d, spent = i[keep], j[keep], d[keep], spent[keep]
    full = np.bitwise_count(d) <= t
    return i[full], j[full]


def _pair_links(groups: DataFrame, m: int, t: int) -> DataFrame:
    """Links (a, b), a > b, between the members (fp, rep) of bounded groups."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out_a, out_b = [], []
        for start, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fps = np.array([x["fp"] for x in members], np.int64).view(np.uint64)
            rep = np.array([x["rep"] for x in members], np.int64)
            i, j = chain_links(fps, start, m, t)
            out_a.append(np.maximum(rep[i], rep[j]))
            out_b.append(np.minimum(rep[i], rep[j]))
        a, c = np.concatenate(out_a), np.concatenate(out_b)
        keep = a != c  # a variant may list one fingerprint twice
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], ["a", "b"])

    return map_arrow(groups, batch, "a long, b long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a > b: every pair of ``distinct`` (fp, rep) within ``max_bits`` bits, by representative."""
    m, t = segments, max_bits
    run, masks = key_run(m, t), segment_masks(m)
    keys = []
    for s in range(m):
        mask = 0
        for l in range(run):
            mask |= masks[(s + l) % m]
        keys.append(mask)
    cells = distinct.select("fp", "rep", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(_signed(k))) for k in keys])).alias("start", "cell"))
    sizes = materialize(cells.groupBy("start", "cell").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = materialize(join_lookup(cells, sizes, ["start", "cell"], "n", m * distinct.count()), "cells")
    small = (shared.filter(F.col("n") <= bucket_rows).groupBy("start", "cell")
             .agg(F.collect_list(F.struct("fp", "rep")).alias("members")))
    found = _pair_links(small.select("start", "members"), m, t)
    # over-full buckets: meet in a common variant within ceil(t / 2) bits outside the key
    flips = [sum(1 << x for x in c) for r in range((t + 1) // 2 + 1) for c in itertools.combinations(range(64), r)]
    free = F.element_at(F.array(*[F.lit(_signed(k)) for k in keys]), F.col("start") + 1)
    hot = (shared.filter(F.col("n") > bucket_rows)
           .withColumn("flip", F.explode(F.array(*[F.lit(_signed(x)) for x in flips])))
           .filter(F.col("flip").bitwiseAND(free) == 0)
           .select("start", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"), "fp", "rep")
           .groupBy("start", "meet").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
           .filter(F.size("members") > 1))
    found = found.unionByName(_pair_links(hot.select(F.lit(None).cast("int").alias("start"), "members"), m, t))
    out = materialize(found.distinct(), "links")
    discard(shared, sizes)
    return out


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return tuple(r)


def _star(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    least = materialize(least, "least")
    out = join_lookup(rows, least, "u", "n", total)
    out._lookup = least
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a > b) with the smallest node it reaches."""
    count, mark = _state(edges)
    while count:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"),
                                                  F.count("*").alias("n")), 2 * count)
        e1 = materialize(large.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = e1.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down, down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), max(count, 1))
        e2 = materialize(small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
                                                        F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
                         .select("e.a", "e.b").filter("a != b").distinct(), "small")
        discard(edges, e1, large._lookup, small._lookup)
        edges, seen = e2, (count, mark)
        count, mark = _state(edges)
        if (count, mark) == seen:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    segments: int = SEGMENTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prepare(docs.sparkSession)
    fps = materialize(fingerprints(docs, k), "fps")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "groups")
    total = fps.count()
    edges = links(groups.filter("rep IS NOT NULL").select("fp", "rep"), max_bits, segments, bucket_rows)
    roots = components(edges)
    named = materialize(groups.join(roots, groups["rep"] == roots["node"], "left")
                        .select("fp", "n", F.coalesce("root", "rep").alias("component_id")), "named")
    return join_lookup(fps, named, "fp", "n", total).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id.

    Among rows that repeat that id one stays, the first by content hash.  A row without id
    stays unless its component is named by a document that has one.
    """
    from pyspark.sql import Window
    found = materialize(near_duplicates(docs, **parameters), "near")
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    columns = docs.columns
    names = [f"__c{i}" for i in range(len(columns))]  # the work columns cannot clash
    renamed, key = docs.toDF(*names), names[columns.index("doc_id")]
    order = Window.partitionBy(key).orderBy(F.xxhash64(*names))
    kept = (renamed.join(keep, renamed[key] == keep["__keep"], "left_semi").withColumn("__nth", F.row_number().over(order))
            .filter("__nth = 1").select(*names))
    lone = found.filter("doc_id IS NULL AND component_id IS NULL").select(
        F.conv("fingerprint", 16, -10).cast("long").alias("__lone")).distinct()
    fp_of = fingerprints_of_rows(renamed.filter(F.col(key).isNull()), parameters.get("k", SHINGLE_WORDS), columns.index("text"))
    return kept.unionByName(fp_of.join(lone, fp_of["__fp"] == lone["__lone"], "left_semi").select(*names)).toDF(*columns)


def fingerprints_of_rows(docs: DataFrame, k: int, at: int) -> DataFrame:
    """``docs`` with the fingerprint of the text in column ``at`` as column ``__fp``."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, k) for x in text_bytes(b.column(at))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], [*b.schema.names, "__fp"])

    from pyspark.sql.types import LongType, StructField, StructType
    return map_arrow(docs, batch, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
