"""One-pass multi-dictionary term scan (Aho-Corasick in an Arrow UDF).

Counting k terms with ``replace``/``length`` expressions costs 2k passes over
every text; this scan finds every occurrence of every term in one pass and
then applies the per-term non-overlapping rule of ``str.count``, so the counts,
first positions and distinct-term counts are exactly those of the expression
path (``text.count_terms`` / ``first_position`` / ``distinct_present``).
"""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts are joined and scanned in pieces of about so many characters.
PIECE_CHARS = 4_000_000


def scan_schema(names) -> str:
    return ", ".join(f"{n}_count LONG, {n}_first LONG, {n}_distinct LONG" for n in names) + ", n_words LONG"


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of about ``most`` in all, one row at least."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _overlaps_itself(term: str) -> bool:
    return any(term[:k] == term[-k:] for k in range(1, len(term)))


def term_scan(df: DataFrame, text_col: str, dicts: dict[str, list[str]], out: str = "_scan") -> DataFrame:
    """Add ``out`` STRUCT with ``<name>_count`` (sum of per-term counts, list
    multiplicity kept), ``<name>_first`` (smallest start, -1 if none) and
    ``<name>_distinct`` (distinct list terms present) for every dictionary, and
    ``n_words`` (whitespace words).  The hits of a piece are counted by array operations."""
    names = list(dicts)
    entries: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        for t in dicts[name]:
            if t:
                entries.setdefault(t.lower(), []).append(i)
    terms, width = list(entries), len(names)
    length = np.array([len(t) for t in terms], dtype=np.int64)
    again = np.array([_overlaps_itself(t) for t in terms], dtype=bool)
    times = np.zeros((len(terms), width), dtype=np.int64)  # of a term in a dictionary
    for i, owners in enumerate(entries.values()):
        np.add.at(times[i], owners, 1)
    gap = next(c for c in map(chr, range(1, 0x110000)) if not any(c in t for t in terms))

    made = []  # the automaton, once a task

    @F.arrow_udf(f"struct<{scan_schema(names).replace(' LONG', ':bigint')}>")
    def scan(batch: pa.Array) -> pa.Array:  # not an iterator, so that several scans of a row share a worker
        import ahocorasick
        if not made:
            auto = ahocorasick.Automaton()
            for i, term in enumerate(terms):
                auto.add_word(term, i)
            if terms:
                auto.make_automaton()
            made.append(auto)
        texts = [t or "" for t in batch.to_pylist()]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        parts = [counts(made[0], texts[a:b], sizes[a:b]) for a, b in pieces(sizes, PIECE_CHARS)]
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * (3 * width + 1)
        fields = [f"{n}_{k}" for n in names for k in ("count", "first", "distinct")] + ["n_words"]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields)

    def counts(auto, texts: list[str], sizes: np.ndarray) -> list[np.ndarray]:
        rows = len(texts)
        ends = np.cumsum(sizes)
        found = auto.iter(gap.join(texts)) if terms else ()
        hits = np.fromiter(chain.from_iterable(found), dtype=np.int64).reshape(-1, 2)
        term = hits[:, 1]
        start = hits[:, 0] - length[term] + 1
        row = np.searchsorted(ends, start, "right")
        start = start - (ends - sizes)[row]
        counted = np.ones(len(term), dtype=bool)
        last: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(again[term]).tolist():  # non-overlapping per term, like str.count
            key, s = (int(row[i]), int(term[i])), int(start[i])
            if s > last.get(key, -1):
                last[key] = s + int(length[term[i]]) - 1
            else:
                counted[i] = False
        present = np.unique(row * max(1, len(terms)) + term)
        p_row, p_term = np.divmod(present, max(1, len(terms)))
        cols = []
        for n in range(width):
            of = times[term, n]
            mine = of > 0
            first = np.full(rows, np.iinfo(np.int64).max)
            np.minimum.at(first, row[mine], start[mine])
            first[first == np.iinfo(np.int64).max] = -1
            use = mine & counted
            cols += [np.bincount(row[use], weights=of[use], minlength=rows).astype(np.int64), first,
                     np.bincount(p_row[times[p_term, n] > 0], minlength=rows)]
        return [*cols, np.fromiter((len(t.split()) for t in texts), dtype=np.int64, count=rows)]

    return df.withColumn(out, scan(F.col(text_col)))
