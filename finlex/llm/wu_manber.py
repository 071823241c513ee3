"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 8).

Texts become sequences of words (A-Z lower-cased; runs of ASCII letters, digits and
anything beyond ASCII).  A pattern is a window of ``window`` consecutive words of an item,
or the whole of a shorter item.  Patterns of one length share Wu-Manber tables over word
symbols: the shift table says for a block of two words how far the search may jump, a
block with shift zero leads to the bucket of patterns that end in it, and the words
themselves are compared to confirm.

The items are read in blocks of bounded size (``block_bytes``); each block's tables go to
the tasks as one broadcast, and the documents pass through block after block without any
shuffle.

Defined cases: null texts and texts without words have no hits; items without words match
nothing; repeated documents each get their row; items with a null id still match but are
not listed or counted; an empty benchmark leaves all documents clean; input columns keep
their names, the work columns start with ``__``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO_WORDS = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20) for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


class Tables:
    """Wu-Manber tables of the patterns of one length ``m`` over word numbers."""

    def __init__(self, m: int, patterns: list[tuple[int, ...]], base: int):
        self.m, self.b, self.base = m, min(2, m), base
        self.patterns = patterns
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for end in range(self.b, m + 1):
                block = self.block(p, end)
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.bucket[self.block(p, m)].append(k)
        self.bucket = dict(self.bucket)

    def block(self, p, end: int) -> int:
        return p[end - 2] * self.base + p[end - 1] if self.b == 2 else p[end - 1]

    def search(self, ids: list[int]) -> list[tuple[int, int]]:
        """(end, pattern) of every occurrence in ``ids``; -1 is a word of no pattern."""
        m, base, found = self.m, self.base, []
        shift, bucket, patterns = self.shift.get, self.bucket, self.patterns
        jump = m - self.b + 1
        pos, n, two = m, len(ids), self.b == 2
        while pos <= n:
            last = ids[pos - 1]
            if last < 0:  # no pattern has this word
                pos += m
                continue
            block = ids[pos - 2] * base + last if two else last
            s = shift(block, jump)
            if s:
                pos += s
                continue
            here = tuple(ids[pos - m:pos])
            for k in bucket[block]:
                if patterns[k] == here:
                    found.append((pos, k))
            pos += 1
        return found


class Matcher:
    """The tables of all patterns of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, data in items:
            ids = [number.setdefault(w, len(number)) for w in words_of(data)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                owners[tuple(ids[i:i + m])].add(item)
        by_length = defaultdict(list)
        for p in owners:
            by_length[len(p)].append(p)
        base = len(number) + 1
        self.tables = [(Tables(m, ps, base), [owners[p] for p in ps]) for m, ps in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans of the occurrences and the ids of their items."""
        number = self.vocabulary.get
        ids = [number(w, -1) for w in words]
        spans, items = [], set()
        for tables, owners in self.tables:
            for end, k in tables.search(ids):
                spans.append((end - tables.m, end))
                items |= owners[k]
        items.discard(None)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = T.StructType([T.StructField("__n_words", T.LongType()),
                     T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType()))),
                     T.StructField("__items", T.ArrayType(T.LongType()))])


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         text: str = "text") -> DataFrame:
    """``docs``, whose texts are in column ``text``, with ``__n_words``, ``__spans`` (merged word spans hit) and ``__items`` (ids of items found)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    at, width = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *HITS.fields])
    out = docs
    for k in range(blocks):
        rows = [(r[0], (r[1] or "").encode()) for r in dealt.filter(F.col("block") == k).select("item_id", "text").collect()]
        matcher = spark.sparkContext.broadcast(Matcher(rows, window))

        def batch(b: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch:
            before = b.num_columns > width
            n, spans, found = [], [], []
            for row, data in enumerate(text_bytes(b.column(at))):
                words = words_of(data)
                s, i = matcher.value.hits(words)
                if before:
                    s += [tuple(x) for x in b.column(width + 1)[row].as_py()]
                    i |= set(b.column(width + 2)[row].as_py())
                n.append(len(words))
                spans.append([list(x) for x in merged(s)])
                found.append(sorted(i))
            return pa.RecordBatch.from_arrays(
                [*b.columns[:width], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array(found, pa.list_(pa.int64()))], [*b.schema.names[:width], *HITS.fieldNames()])

        out = map_arrow(out, batch, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    columns = docs.columns
    names = [f"__c{i}" for i in range(len(columns))]  # the work columns cannot clash
    found = mark(docs.toDF(*names), benchmark, text=names[columns.index("text")], **parameters)
    return found.filter(F.size("__spans") == 0).select(*names).toDF(*columns)


def report(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = mark(docs.select("doc_id", "text"), benchmark, **parameters).drop("text")
    names = F.array_sort(F.transform("__items", lambda x: x.cast("string")))
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"),
                        F.size("__items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """The same row by comparing every window at every position; for tests."""
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, item_text in items:
        w = words_of((item_text or "").encode())
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for p in range(len(words) - m + 1):
                if words[p:p + m] == w[i:i + m]:
                    hit |= set(range(p, p + m))
                    found.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)
