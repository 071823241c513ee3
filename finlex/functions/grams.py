"""N-grams of normalised texts in Arrow batches: counts per task, and vocabulary hits per row.

Each step is narrow.  A task counts into dictionaries of bounded size and hands on sums, so
what is shuffled is a row a term and task, not a row an occurrence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import pieces

# Texts are split in pieces of about so many bytes.
PIECE_BYTES = 8_000_000
# A task's dictionary of terms is handed on when it has so many (about 50 MB).
TERMS_HELD = 200_000


def text_grams(norm: str | None, lo: int, hi: int, min_chars: int) -> list[str]:
    """Space-joined n-grams of the words of ``min_chars`` and more, n-major."""
    w = [x for x in norm.split(" ") if x and len(x) >= min_chars] if norm else []
    out = []
    for n in range(lo, hi + 1):
        out += w if n == 1 else map(" ".join, zip(*[w[i:] for i in range(n)]))
    return out


def _coded(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and dictionary position of each word of ``min_chars`` and more, and the dictionary."""
    split = pc.split_pattern(texts, " ")
    sizes = split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = split.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    if not len(code):
        return row, code, words.dictionary
    kept = pc.greater_equal(pc.utf8_length(words.dictionary), max(1, min_chars)).to_numpy(zero_copy_only=False)[code]
    return row[kept], code[kept], words.dictionary


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    if len(texts):
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        for a, b in pieces(sizes, PIECE_BYTES):
            yield texts.slice(a, b - a)


def _known_grams(texts: pa.Array, min_chars: int, words: pa.Array, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, row, number) of the n-grams whose words are all in ``words``; the number's digits to base len(words) are their positions."""
    row, code, names = _coded(texts, min_chars)
    known = pc.index_in(names, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = known[code] if len(code) else code
    number, ok = at, at >= 0
    for n in range(1, hi + 1):
        if n > 1:
            k = len(at) - n + 1
            if k < 1:
                return
            ok = ok[:k] & (at[n - 1:] >= 0) & (row[:k] == row[n - 1:])
            number = number[:k] * len(words) + at[n - 1:]
        if n >= lo:
            yield n, row[:len(ok)][ok], number[ok]


def numbered(words: int, hi: int) -> bool:
    """N-grams of so many words have a number in 64 bits."""
    return words ** hi < 2 ** 62


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each is (one sort: ``np.unique`` takes ten times as long)."""
    v = np.sort(values)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(v)), dtype=bool), v[1:] != v[:-1]]))
    return v[first], np.diff(np.append(first, len(v)))


def _code_counts(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows each code is, and how often."""
    pairs, _ = _runs(row * max(1, codes) + code)
    return np.bincount(pairs % max(1, codes), minlength=codes), np.bincount(code, minlength=codes)


def gram_counts(docs: DataFrame, norm_col: str, lo: int, hi: int, min_chars: int, words: list[str] | None = None) -> DataFrame:
    """(term, df, tf): partial sums over the rows of a task; a term may have several rows.

    With ``words`` only of the n-grams whose words are all among them: their numbers are
    counted, and terms are made of the sums.
    """
    def batch(terms, df, tf) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(df, pa.int64()), pa.array(tf, pa.int64())],
                                          ["term", "df", "tf"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df = Counter(), Counter()
        for b in batches:
            for texts in _slices(b.column(0)):
                if lo == hi == 1:
                    row, code, names = _coded(texts, min_chars)
                    in_rows, times = _code_counts(row, code, len(names))
                    found = np.flatnonzero(times)
                    terms = names.take(pa.array(found)).to_pylist()
                    tf.update(dict(zip(terms, times[found].tolist())))
                    df.update(dict(zip(terms, in_rows[found].tolist())))
                else:
                    for text in texts.to_pylist():
                        g = text_grams(text, lo, hi, min_chars)
                        tf.update(g)
                        df.update(set(g))
                        if len(tf) > TERMS_HELD:
                            yield batch(list(tf), [df[t] for t in tf], tf.values())
                            tf.clear()
                            df.clear()
                if len(tf) > TERMS_HELD:
                    yield batch(list(tf), [df[t] for t in tf], tf.values())
                    tf.clear()
                    df.clear()
        if tf:
            yield batch(list(tf), [df[t] for t in tf], tf.values())

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(words, pa.string())
        held: dict[int, list] = {n: [] for n in range(lo, hi + 1)}

        def merged(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            value, df, tf = (np.concatenate(c) for c in zip(*held[n]))
            order = np.argsort(value, kind="stable")
            value = value[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(value)), dtype=bool), value[1:] != value[:-1]]))
            return value[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in (df, tf))

        def out(n: int) -> pa.RecordBatch:
            value, df, tf = merged(n)
            held[n] = []
            parts = [names.take(pa.array(value // len(words) ** k % len(words))) for k in range(n - 1, -1, -1)]
            return batch(pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0], df, tf)

        for b in batches:
            for texts in _slices(b.column(0)):
                for n, row, number in _known_grams(texts, min_chars, names, lo, hi):
                    found = pa.array(number).dictionary_encode()
                    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    held[n].append((found.dictionary.to_numpy(zero_copy_only=False), *_code_counts(row, code, len(found.dictionary))))
                    if sum(len(p[0]) for p in held[n]) > 4 * TERMS_HELD:
                        held[n] = [merged(n)]
                        if len(held[n][0][0]) > 2 * TERMS_HELD:
                            yield out(n)
        for n in held:
            if held[n]:
                yield out(n)

    if words is not None and not numbered(len(words), hi):
        raise ValueError(f"{hi}-grams of {len(words)} words have no number")
    return docs.select(norm_col).mapInArrow(plain if words is None else among, "term STRING, df BIGINT, tf BIGINT")


def _lists(offsets: list[int], values: list, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


# ---------------------------------------------------------------- a document's terms as bytes

# What Spark passes on as bytes it neither takes apart nor builds up value by value: a document's
# positions are little-endian numbers of 2 or 4 bytes, its counts a byte each, and where one is over
# 255 the rest of all the document's counts (n >> 8) stands in ``over``.
PACKED = ("idx", "n", "over")
PACKED_SCHEMA = "idx BINARY, n BINARY, over BINARY"


def _position(n_terms: int) -> np.dtype:
    return np.dtype("<u2" if n_terms <= 65_536 else "<i4")


def _bytes(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary per row of the values from ``at`` to the next."""
    offsets = (at * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _packed(row: np.ndarray, idx: np.ndarray, n: np.ndarray, rows: int, n_terms: int) -> list[pa.Array]:
    """``PACKED`` columns of (row, position, count), ascending by row."""
    sizes = np.bincount(row, minlength=rows)
    large = np.zeros(rows, dtype=bool)
    large[row[n > 255]] = True
    rest = (n[large[row]] >> 8).astype("<i4") if large.any() else np.zeros(0, dtype="<i4")
    at, rest_at = (np.concatenate([[0], np.cumsum(k)]) for k in (sizes, sizes * large))
    return [_bytes(at, idx.astype(_position(n_terms))), _bytes(at, (n & 255).astype(np.uint8)), _bytes(rest_at, rest)]


def _raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a binary column."""
    if not len(col):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    o = np.frombuffer(offsets, dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return o - o[0], np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, dtype=np.uint8)


def _unpacked(cols: list[pa.Array], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's terms begin, and positions and counts of all."""
    kind = _position(n_terms)
    at, idx = _raw(cols[0])
    at, n = at // kind.itemsize, _raw(cols[1])[1].astype(np.int64)
    rest_at, rest = _raw(cols[2])
    if len(rest):
        n[np.repeat(np.diff(rest_at) > 0, np.diff(at))] += rest.view("<i4").astype(np.int64) << 8
    return at, idx.view(kind).astype(np.int64), n


def _fields(rows: DataFrame, cols: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols)


def unpack(rows: DataFrame, keep: tuple[str, ...], n_terms: int) -> DataFrame:
    """(*keep, idx ARRAY<INT>, n ARRAY<BIGINT>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, idx, n = _unpacked(b.columns[len(keep):], n_terms)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], _lists(at, idx, pa.int32()), _lists(at, n, pa.int64())], [*keep, "idx", "n"])

    return rows.select(*keep, *PACKED).mapInArrow(run, f"{_fields(rows, keep)}, idx ARRAY<INT>, n ARRAY<BIGINT>")


def pack(rows: DataFrame, keep: tuple[str, ...], n_terms: int) -> DataFrame:
    """The other way round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, n = b.columns[len(keep):]
            row = np.repeat(np.arange(b.num_rows), idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            cols = _packed(row, *(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (idx, n)), b.num_rows, n_terms)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *cols], [*keep, *PACKED])

    return rows.select(*keep, "idx", "n").mapInArrow(run, f"{_fields(rows, keep)}, {PACKED_SCHEMA}")


def vocabulary_hits(docs: DataFrame, norm_col: str, keep: tuple[str, ...], terms: list[str], lo: int, hi: int, min_chars: int) -> DataFrame:
    """(*keep, ``PACKED``): positions in ``terms`` and counts, ascending, one row a row of ``docs``."""
    rows = docs.select(*keep, norm_col)

    words = sorted({w for t in terms for w in t.split(" ")})
    place = {w: i for i, w in enumerate(words)}
    by_number: dict[int, list[tuple[int, int]]] = {n: [] for n in range(1, hi + 1)}  # (number, position in terms)
    if numbered(max(1, len(words)), hi):
        for i, t in enumerate(terms):
            w = t.split(" ")
            if lo <= len(w) <= hi:
                by_number[len(w)].append((sum(place[x] * len(words) ** (len(w) - 1 - j) for j, x in enumerate(w)), i))
    tables = {n: (np.array([x for x, _ in v], dtype=np.int64), np.array([i for _, i in v], dtype=np.int64)) for n, v in by_number.items()}

    def hits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and position of every hit."""
        rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n, row, number in _known_grams(texts, min_chars, pa.array(words, pa.string()), lo, hi):
            numbers, places = tables[n]
            if len(numbers):
                at = pc.index_in(pa.array(number), value_set=pa.array(numbers)).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = at >= 0
                rows.append(row[hit])
                found.append(places[at[hit]])
        return np.concatenate(rows), np.concatenate(found)

    def plain_hits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = {t: i for i, t in enumerate(terms)}
        pairs = [(r, i) for r, text in enumerate(texts.to_pylist()) for i in map(ids.get, text_grams(text, lo, hi, min_chars)) if i is not None]
        return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = hits if numbered(max(1, len(words)), hi) else plain_hits
        for b in batches:
            from_row = 0
            for texts in _slices(b.column(len(keep))):
                row, found = find(texts)
                pair, n = _runs(row * max(1, len(terms)) + found)
                row, idx = np.divmod(pair, max(1, len(terms)))
                yield pa.RecordBatch.from_arrays([*(c.slice(from_row, len(texts)) for c in b.columns[:len(keep)]),
                                                  *_packed(row, idx, n, len(texts), len(terms))], [*keep, *PACKED])
                from_row += len(texts)

    return rows.mapInArrow(run, f"{_fields(rows, keep)}, {PACKED_SCHEMA}")


def weighted(rows: DataFrame, keep: tuple[str, ...], idf: list[float]) -> DataFrame:
    """(*keep, idx, w ARRAY<DOUBLE>, sq): n * idf and the sum of their squares."""
    of = np.array(idf, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, idx, n = _unpacked(b.columns[len(keep):], len(of))
            w = n * of[idx]
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            sq = np.bincount(row, weights=w * w, minlength=b.num_rows)  # integers where no row has a term
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], _lists(at, idx, pa.int32()), _lists(at, w, pa.float64()),
                                              pa.array(sq.astype(np.float64), pa.float64())], [*keep, "idx", "w", "sq"])

    return rows.select(*keep, *PACKED).mapInArrow(run, f"{_fields(rows, keep)}, idx ARRAY<INT>, w ARRAY<DOUBLE>, sq DOUBLE")


# ---------------------------------------------------------------- sums over documents' weights, without a row a term

def _weights(cols: list[pa.Array], n_terms: int, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, weight) of a batch's ``PACKED`` and numeric columns, a document's L2-normalised n * idf, or 1.

    A numeric column's position is after the terms; its weight is its value, or 1 above zero.
    """
    at, idx, n = _unpacked(cols[:3], n_terms)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if idf is None:
        w = np.ones(len(idx))
    else:
        w = n * idf[idx]
        w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(at) - 1))[row]
    if len(cols) > 3:
        x = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False), nan=0.0) for c in cols[3:]], axis=1)
        r, j = np.nonzero(x > 0 if idf is None else x)
        row, idx = np.concatenate([row, r]), np.concatenate([idx, n_terms + j])
        w = np.concatenate([w, np.ones(len(r)) if idf is None else x[r, j]])
    return row, idx, w


# Sums that a task holds, classes x terms (32 MB).
SUMS_HELD = 4_000_000


def weight_sums(rows: DataFrame, label: str | None, n_terms: int, idf: list[float] | None = None, numeric: tuple[str, ...] = ()) -> DataFrame:
    """(label, idx, x, n): partial sums of the weights of each position, and how many rows have it; without ``label`` over all rows."""
    width = n_terms + len(numeric)
    of = None if idf is None else np.array(idf, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for t, (x, n) in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.float64()),
                                                  pa.array(n[at].astype(np.int64), pa.int64())], ["label", "idx", "x", "n"])
            held.clear()

        for b in batches:
            labels = b.column(0).dictionary_encode()
            names = [*labels.dictionary.to_pylist(), None]
            code = labels.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
            row, idx, w = _weights(b.columns[1:], n_terms, of)
            of_row = code[row]
            found = np.flatnonzero(np.bincount(code, minlength=len(names)))
            for c in found:
                mine = of_row == c if len(found) > 1 else slice(None)
                got = np.stack([np.bincount(idx[mine], weights=w[mine], minlength=width), np.bincount(idx[mine], minlength=width)])
                held[names[c]] = held[names[c]] + got if names[c] in held else got
                if len(held) * width > SUMS_HELD:
                    yield from out()
        yield from out()

    by = F.lit("").alias("label") if label is None else F.col(label).cast("string").alias("label")
    return rows.select(by, *PACKED, *[F.col(c).cast("double").alias(c) for c in numeric]).mapInArrow(run, "label STRING, idx INT, x DOUBLE, n BIGINT")


def weight_products(rows: DataFrame, keep: tuple[str, ...], per_term: np.ndarray, base: list[float], n_terms: int,
                    idf: list[float] | None = None, numeric: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, _s0, _s1, ...): ``base`` plus the sum of weight times ``per_term`` (position x column) over each row's terms."""
    of = None if idf is None else np.array(idf, dtype=np.float64)
    names = [f"_s{i}" for i in range(per_term.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.ascontiguousarray(per_term[:, i]) for i in range(per_term.shape[1])]
        for b in batches:
            row, idx, w = _weights(b.columns[len(keep):], n_terms, of)
            sums = [np.bincount(row, weights=w * c[idx], minlength=b.num_rows) + base[i] for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *(pa.array(s, pa.float64()) for s in sums)], [*keep, *names])

    return rows.select(*keep, *PACKED, *[F.col(c).cast("double").alias(c) for c in numeric]) \
        .mapInArrow(run, f"{_fields(rows, keep)}, {', '.join(f'{n} DOUBLE' for n in names)}")


def weight_profile(rows: DataFrame, n_terms: int, idf: list[float]) -> DataFrame:
    """(doc_id, nnz, max_w, sq_norm) of the rows that have a term."""
    of = np.array(idf, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, w = _weights(b.columns[1:], n_terms, of)
            size = np.bincount(row, minlength=b.num_rows)
            has = np.flatnonzero(size)
            top = np.maximum.reduceat(w, (np.cumsum(size) - size)[has]) if len(has) else w
            sq = np.bincount(row, weights=w * w, minlength=b.num_rows)[has].astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(size[has].astype(np.int64), pa.int64()), pa.array(top, pa.float64()),
                                              pa.array(sq, pa.float64())], ["doc_id", "nnz", "max_w", "sq_norm"])

    return rows.select("doc_id", *PACKED).mapInArrow(run, f"{_fields(rows, ('doc_id',))}, nnz BIGINT, max_w DOUBLE, sq_norm DOUBLE")


def term_of(terms: list[str], idx: str) -> Column:
    """The term at a position; a literal of the vocabulary, which is bounded.  No term holds a line break."""
    return F.element_at(F.split(F.lit("\n".join(terms)), "\n"), F.col(idx) + 1)
