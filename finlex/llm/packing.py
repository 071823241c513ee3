"""Conflict-constrained best-fit packing (operator 4).

Documents go into sequences ("bins") of ``capacity`` tokens.  No bin holds two documents of
one source or of one duplicate cluster.  Documents longer than a bin fill whole bins of
their own; only their remainder is packed.  Within a packing group the pieces come longest
first; open bins stand ordered by residual capacity and carry a bitmap of their sources and
one of their clusters.  The search starts at the smallest residual that holds the piece and
goes on to the successor until a bin without conflict is found: the tightest compatible
one.  If none is, a new bin opens.  The order is kept in blocks; a block whose bins all
carry the piece's source, or all its cluster, is passed over in one step.

Groups are dealt by a hash of the row, not by source or cluster, in such number that each
expects at most ``group_bins`` bins' worth of tokens and ``GROUP_ROWS`` documents; so a hot
source or cluster spreads evenly and no task's work grows with the corpus.  Packing across
groups would save less than one bin a group.

Lengths are tokens of a word-piece vocabulary, or words when none is given.  A duplicate
cluster is a component of near copies by SimHash, as in operator 7.

Defined cases: a null text has no tokens and no cluster; every document has one end token
more, so empty ones are packed too; a null source or cluster is never in conflict; repeated rows
are packed each (they share a cluster, so never in one bin); ties go by document id, then
content; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize, prepare, text_bytes
from .simhash_pigeonring import components, fingerprint, links
from .wordpiece_count import CACHE_WORDS, START, Automaton

CAPACITY = 2048
GROUP_BINS = 256
GROUP_ROWS = 1 << 15
BLOCK = 64


def measured(docs: DataFrame, pieces: list[bytes] | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, fp, mark): tokens and end token, fingerprint (null without words), hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces)) if pieces else None

    def run(batches):
        automaton, known = shared and shared.value, {}
        for b in batches:
            n, fp, mark = [], [], []
            for data in text_bytes(b.column(2)):
                words = data.split()
                total = len(words)
                if automaton:
                    total = 0
                    for w in words:
                        count = known.get(w)
                        if count is None:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            count = known[w] = automaton.count(START + w)
                        total += count
                n.append(total + 1)
                f = fingerprint(data) if words else None
                fp.append(f if f is None or f < 1 << 63 else f - (1 << 64))
                mark.append(xxhash.xxh64_intdigest(data) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()),
                                              pa.array(fp, pa.int64()), pa.array(mark, pa.int64())],
                                             ["doc_id", "source", "n_tokens", "fp", "mark"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
            .mapInArrow(run, f"doc_id {kind}, source string, n_tokens long, fp long, mark long"))


def clustered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``cluster``, the near-duplicate component of the fingerprint, instead of ``fp``."""
    sized = materialize(sized, "measured")
    groups = materialize(sized.filter("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")), "groups")
    roots = components(links(groups.select("fp", F.col("fp").alias("rep"))))
    named = materialize(groups.join(roots, groups["fp"] == roots["node"], "left")
                        .select("fp", "n", F.coalesce("root", "fp").alias("cluster")), "named")
    names = ["doc_id", "source", "n_tokens", "cluster", "mark"]
    worded = join_lookup(sized.filter("fp IS NOT NULL"), named, "fp", "n", sized.count())
    return worded.select(*names).unionByName(
        sized.filter("fp IS NULL").withColumn("cluster", F.lit(None).cast("long")).select(*names))


class OpenBins:
    """Bins in order of (residual, number), in blocks that know which bits all their bins carry."""

    def __init__(self) -> None:
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []
        self.in_all: list[tuple[int, int]] = []

    def tightest(self, length: int, s: int, c: int) -> tuple[int, int] | None:
        """Block and place of the first bin that holds ``length`` more and has neither bit."""
        want = (length, -1)
        for k in range(bisect.bisect_left(self.last, want), len(self.blocks)):
            all_s, all_c = self.in_all[k]
            if all_s & s or all_c & c:
                continue
            block = self.blocks[k]
            for at in range(bisect.bisect_left(block, want), len(block)):
                b = block[at][1]
                if not (self.sources[b] & s or self.clusters[b] & c):
                    return k, at
        return None

    def take(self, k: int, at: int) -> tuple[int, int]:
        entry = self.blocks[k].pop(at)
        self._refresh(k)
        return entry

    def put(self, entry: tuple[int, int]) -> None:
        k = min(bisect.bisect_left(self.last, entry), len(self.blocks) - 1)
        if k < 0:
            k = 0
            self._insert(0, [])
        block = self.blocks[k]
        bisect.insort(block, entry)
        if len(block) > 2 * BLOCK:
            self._insert(k + 1, block[BLOCK:])
            del block[BLOCK:]
            self._refresh(k + 1)
        self._refresh(k)

    def _insert(self, k: int, block: list[tuple[int, int]]) -> None:
        self.blocks.insert(k, block)
        self.last.insert(k, (0, 0))
        self.in_all.insert(k, (0, 0))

    def _refresh(self, k: int) -> None:
        block = self.blocks[k]
        if not block:
            del self.blocks[k], self.last[k], self.in_all[k]
            return
        all_s = all_c = -1
        for _, b in block:
            all_s &= self.sources[b]
            all_c &= self.clusters[b]
            if not (all_s or all_c):
                break
        self.last[k] = block[-1]
        self.in_all[k] = all_s, all_c


def pack_group(pieces: list[tuple[int, int | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source bit, cluster bit), in the order given; lengths at most ``capacity``."""
    bins = OpenBins()
    placed = []
    for length, source, cluster in pieces:
        s = 1 << source if source is not None else 0
        c = 1 << cluster if cluster is not None else 0
        found = bins.tightest(length, s, c)
        if found:
            residual, b = bins.take(*found)
        else:
            residual, b = capacity, len(bins.sources)
            bins.sources.append(0)
            bins.clusters.append(0)
        bins.sources[b] |= s
        bins.clusters[b] |= c
        placed.append((b, capacity - residual))
        if residual > length:
            bins.put((residual - length, b))
    return placed


def pack(sized: DataFrame, capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, n_tokens, bin_id, bin_offset.

    ``sized`` has doc_id, n_tokens, source, cluster and mark (a hash to break ties).
    """
    sized = materialize(sized, "sized")
    total, n_rows = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // (capacity * group_bins)), -(-n_rows // GROUP_ROWS))
    dealt = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(groups)))
    names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset"]

    def group(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        ids, n, first = columns["doc_id"], columns["n_tokens"], columns["grp"][0] << 32
        pieces = [(row, k * capacity, min(capacity, n[row] - k * capacity))
                  for row in range(len(n)) for k in range(-(-n[row] // capacity))]
        pieces.sort(key=lambda p: (-p[2], ids[p[0]] is None, ids[p[0]] or 0, columns["mark"][p[0]], p[1]))
        bit: dict = {}
        number = lambda what, x: None if x is None else bit.setdefault((what, x), len(bit))
        # a bitmap bit for each source, and for each cluster that occurs twice: others cannot conflict
        seen: dict = {}
        for x in columns["cluster"]:
            seen[x] = seen.get(x, 0) + 1
        whole = [p[2] == capacity for p in pieces]  # fills a bin alone, nothing can join it
        rest = [p for p, w in zip(pieces, whole) if not w]
        placed = pack_group([(p[2], number("s", columns["source"][p[0]]),
                              number("c", columns["cluster"][p[0]]) if seen[columns["cluster"][p[0]]] > 1 else None)
                             for p in rest], capacity)
        alone = max((b for b, _ in placed), default=-1) + 1
        out = [(ids[r], s // capacity, s, m, first + b, o) for (r, s, m), (b, o) in zip(rest, placed)]
        out += [(ids[r], s // capacity, s, m, first + alone + k, 0)
                for k, (r, s, m) in enumerate(p for p, w in zip(pieces, whole) if w)]
        cols = list(zip(*out))
        types = [table.schema.field("doc_id").type] + [pa.int64()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    kind = sized.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("grp").applyInArrow(group, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def report(docs: DataFrame, capacity: int = CAPACITY, group_bins: int = GROUP_BINS,
           pieces: list[bytes] | None = None) -> DataFrame:
    """Packed ``docs``; lengths are tokens of the vocabulary ``pieces``, or words without one."""
    prepare(docs.sparkSession)
    return pack(clustered(measured(docs, pieces)), capacity, group_bins)
