"""Exact substring deduplication by hashing lines and passages (operator 10).

Units are of two kinds.  Every line (or paragraph, between empty lines) of at least
``line_words`` words is one.  Because a repeated passage may stand inside longer lines,
passages are units too: of every ``window`` consecutive words the one with the smallest
hash (MD5, the first of equal ones) begins a unit of ``passage_words - window + 1`` words.
Where a unit begins depends on the ``window`` words around it alone, so two texts that
share ``passage_words`` words in a row share a unit that lies wholly within them, wherever
they stand; of a shared run at most ``window - 1`` words at each end lie outside its units.

A unit's normal form has A-Z lower-cased and single spaces between words.  Digests are
grouped over all documents: the earliest occurrence, by document id, then position, stays,
all others go, except those that overlap the one that stays in its own text.  Offsets are
code points of the original text from the unit's first word to its last, end exclusive;
removed units of a document may overlap.

Counting the copies of a digest is a map-side combined aggregation; occurrences meet their
group's first by ``join_lookup``, so a line that a third of all documents share is joined
without a shuffle.  Only digests that occur twice take part.

Defined cases: a null or empty text has no units; shorter lines outside repeated passages
are never removed; repeated rows of one document id are copies of each other, the one whose
text hash is smaller stays (equal texts: units of the first by position keep, those of a
whole repeated row cannot be told apart and stay with it); a null id ranks last; an empty
table gives an empty result; other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, map_arrow, materialize, prepare, texts

LINE_WORDS = 5
PASSAGE_WORDS = 50
WINDOW = 15
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    """Word to hash, computed once a word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.md5(word).digest()[:8], "big")
        return h


_hashes = _Hashes()


def passage_starts(words: list[bytes], size: int, window: int = WINDOW) -> list[int]:
    """Numbers of the words that begin a passage of ``size`` words."""
    if len(words) < max(size, window):
        return []
    if len(_hashes) >= CACHE_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1)
    starts = np.unique(least + np.arange(len(least)))
    return starts[starts <= len(words) - size].tolist()


def units(text: str, unit: str = "line", line_words: int = LINE_WORDS, passage_words: int = PASSAGE_WORDS,
          window: int = WINDOW) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    size = passage_words - window + 1
    if len(words) < min(line_words, size):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    # word numbers at which lines (or paragraphs) begin, and the last one's end
    gap = re.compile(r"\n" if unit == "line" else r"\n[ \t-\r]*\n")
    breaks = [i for i in range(1, len(at)) if at[i][0] - at[i - 1][1] > 1 or text[at[i - 1][1]] == "\n"]
    breaks = [i for i in breaks if gap.search(text, at[i - 1][1], at[i][0])]
    lines = [0, *breaks, len(words)]
    spans = {(a, b) for a, b in zip(lines, lines[1:]) if b - a >= max(line_words, 1)}
    spans.update((a, a + size) for a in passage_starts(words, size, window))
    # a unit's normal form is a slice of the words joined by spaces
    flat = b" ".join(words)
    begins = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    digest = xxhash.xxh3_128_digest
    return [(at[a][0], at[b - 1][1], digest(flat[begins[a]:begins[b] - 1])) for a, b in sorted(spans)]


def occurrences(docs: DataFrame, unit: str = "line", **sizes: int) -> DataFrame:
    """(doc_id, mark, start, end, digest): one row per unit."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        doc, mark, start, end, digest = [], [], [], [], []
        for k, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            found = units(text, unit, **sizes)
            m = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63) if found else 0
            for s, e, d in found:
                doc.append(k)
                mark.append(m)
                start.append(s)
                end.append(e)
                digest.append(d)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
             pa.array(digest, pa.binary())], ["doc_id", "mark", "start", "end", "digest"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch,
                     "doc_id long, mark long, start long, end long, digest binary")


def removed(docs: DataFrame, unit: str = "line", **sizes: int) -> DataFrame:
    """(doc_id, start, end, kept_doc_id, kept_start): one row per unit to remove, with the one that stays."""
    prepare(docs.sparkSession)
    found = materialize(occurrences(docs, unit, **sizes), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark", "start", "end")
    first = materialize(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
                        .filter("n > 1"), "first")
    twice = join_lookup(found, first, "digest", "n", found.count())
    stays = (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
             & (F.col("start") < F.col("first.end")))
    return twice.filter(~stays).select("doc_id", "mark", "start", "end", F.col("first.doc_id").alias("kept_doc_id"),
                                       F.col("first.start").alias("kept_start"))


def cleaned(docs: DataFrame, unit: str = "line", **sizes: int) -> DataFrame:
    """``docs`` without the removed units, and without the lines that leaves empty."""
    columns = docs.columns
    names = [f"__c{i}" for i in range(len(columns))]  # the work columns cannot clash
    gone = (removed(docs, unit, **sizes).groupBy("doc_id", "mark")
            .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__gone"))
            .select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__of"), "__gone"))
    at = columns.index("text")
    marked = _marked(docs.toDF(*names), at)
    key = names[columns.index("doc_id")]
    joined = marked.join(gone, marked[key].eqNullSafe(gone["__doc"]) & (marked["__mark"] == gone["__of"]), "left")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist()):
            if spans:
                text = without(text, [(s["start"], s["end"]) for s in spans])
            out.append(text)
        arrays = list(b.columns[:len(columns)])
        arrays[at] = pa.array(out, arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, columns)

    return map_arrow(joined.select(*names, "__gone"), batch, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the sorted ``spans``; a line of which nothing is left goes too."""
    parts, pos = [], 0
    for a, b in spans:
        if a > pos:
            parts.append(text[pos:a])
        if b > pos:
            whole = (a == 0 or text[a - 1] == "\n") and text[b:b + 1] == "\n"
            pos = b + whole
    return "".join([*parts, text[pos:]])


def _marked(docs: DataFrame, at: int) -> DataFrame:
    """``docs`` with ``__mark``, the hash of the text in column ``at``."""
    from pyspark.sql.types import LongType, StructField, StructType

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        mark = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t in texts(b.column(at))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(mark, pa.int64())], [*b.schema.names, "__mark"])

    return map_arrow(docs, batch, StructType([*docs.schema.fields, StructField("__mark", LongType())]))


def report(docs: DataFrame, unit: str = "line", **sizes: int) -> DataFrame:
    return removed(docs, unit, **sizes).drop("mark")
