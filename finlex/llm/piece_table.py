"""Fill-in-middle transformation with a piece table (operator 11).

A document is a list of descriptors (buffer, start, length) over immutable buffers: its own
text and the text of the sentinels.  Cutting splits descriptors, an arrangement permutes
them and puts sentinel descriptors between them, the inverse permutation restores the
document, and a hash streams the descriptors' spans; the text itself is never edited.
The descriptors count bytes, so a span is a slice; cuts are made at code points.

The draws come from ``sha256("<seed>:<doc_id>")`` alone, so a document's form does not
depend on other rows, their order or a lost task.  A document is plain when its text is
empty, holds a sentinel, or is drawn so.  The sentinels start with ``<`` and end with ``>``
and the text holds none of them, so each occurs once in an output and restoring needs only
the output and its form.

Everything is one narrow step: no shuffle, and memory for one Arrow batch.

Defined cases: a null text is empty, a null ``doc_id`` is written as no digits; repeated
rows each get their row; an empty table gives an empty result; other columns are kept by
``transform`` (a column named as a new one is replaced) and not read by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 1
PLAIN_FROM = 90  # percent: draws from here on stay plain
SPM_BELOW = 20   # percent of the transformed ones that take the suffix first

TEXT, MARKS = 0, 1  # the two buffers
MARK_BUFFER = b"".join(SENTINELS)

# The parts of a document by their place in its text, in the order each form writes them,
# as (sentinel, part): indexes of SENTINELS and of prefix, middle, suffix.
ARRANGEMENTS = {"psm": ((0, 0), (1, 2), (2, 1)), "spm": ((1, 2), (0, 0), (2, 1))}


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over an immutable text and the sentinels' buffer."""

    def __init__(self, text: bytes, pieces: Iterable[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(MARK_BUFFER))
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, at: int) -> None:
        """Split the descriptor around byte ``at`` of the document; a cut at an edge leaves an empty piece beside it."""
        seen = 0
        for k, p in enumerate(self.pieces):
            if at <= seen + p.length:
                left = at - seen
                self.pieces[k:k + 1] = [Piece(p.buffer, p.start, left), Piece(p.buffer, p.start + left, p.length - left)]
                return
            seen += p.length
        raise IndexError(at)

    def arrange(self, form: str) -> None:
        """Permute three parts and put each one's sentinel before it."""
        out = []
        for mark, part in ARRANGEMENTS[form]:
            out += [Piece(MARKS, sum(map(len, SENTINELS[:mark])), len(SENTINELS[mark])), self.pieces[part]]
        self.pieces = out

    def restore(self, form: str) -> None:
        """Inverse of ``arrange``: drop the sentinels' descriptors and put the parts back in the text's order."""
        parts: list = [None] * 3
        for (_, part), piece in zip(ARRANGEMENTS[form], self.pieces[1::2]):
            parts[part] = piece
        self.pieces = parts

    def spans(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start:p.start + p.length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for span in self.spans():
            h.update(span)
        return h.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.spans())

    @classmethod
    def of_output(cls, output: bytes, form: str) -> PieceTable:
        """The arranged descriptors of an output, found by its sentinels."""
        pieces, at = [], 0
        marks = [SENTINELS[m] for m, _ in ARRANGEMENTS[form]]
        for mark, following in zip(marks, [*marks[1:], None]):
            if not output.startswith(mark, at):
                raise ValueError(f"not an output of form {form}")
            begin = at + len(mark)
            at = len(output) if following is None else output.index(following, begin)
            pieces += [Piece(TEXT, begin - len(mark), len(mark)), Piece(TEXT, begin, at - begin)]
        return cls(output, pieces)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def code_points(data: bytes) -> np.ndarray | None:
    """Byte offsets of the code points and the end; None when they are all single bytes."""
    if data.isascii():
        return None
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


class Made(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    table: PieceTable


def make(doc_id: int | None, data: bytes, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> Made:
    """The arranged piece table of one document."""
    offsets = code_points(data)
    n = len(data) if offsets is None else len(offsets) - 1
    table = PieceTable(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= plain_from or any(s in data for s in SENTINELS):
        return Made(n, "plain", None, None, table)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < spm_below else "psm"
    for c in (low, high):
        table.cut(c if offsets is None else int(offsets[c]))
    # a cut on the edge of an earlier empty piece leaves the same three parts, in order
    table.arrange(form)
    return Made(n, form, low, high - low, table)


def restored(output: bytes, form: str) -> PieceTable:
    """The document's own piece table, over an output."""
    if form == "plain":
        return PieceTable(output)
    table = PieceTable.of_output(output, form)
    table.restore(form)
    return table


NEW = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output")
_PIECES = "array<struct<buffer:int,start:bigint,length:bigint>>"


def transform(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, pieces (byte descriptors: buffer 0 the text, 1 the sentinels) and output.

    Percentages and seed are parameters; ``text`` stays as it was.
    """
    prepare(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in docs.columns if c.lower() not in ("doc_id", *NEW)])
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(
        f"n long, form string, prefix_chars long, middle_chars long, pieces {_PIECES}, output string").fields])
    at_id, at_text = kept.columns.index("doc_id"), kept.columns.index("text")
    piece_type = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [make(k, t, seed, plain_from, spm_below) for k, t in zip(b.column(at_id).to_pylist(), text_bytes(b.column(at_text)))]
        new = [pa.array([m.n for m in made], pa.int64()), pa.array([m.form for m in made], pa.string()),
               pa.array([m.prefix_chars for m in made], pa.int64()), pa.array([m.middle_chars for m in made], pa.int64()),
               pa.array([[p._asdict() for p in m.table.pieces] for m in made], piece_type),
               pa.array([m.table.text() for m in made], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*b.columns, *new], [f.name for f in schema.fields])

    return map_arrow(kept, run, schema)


def restore(outputs: DataFrame) -> DataFrame:
    """``text`` rebuilt from ``output`` and ``form``; all other columns are kept."""
    prepare(outputs.sparkSession)
    kept = outputs.select(*[c for c in outputs.columns if c != "text"])
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])
    at_out, at_form = kept.columns.index("output"), kept.columns.index("form")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        back = [restored(o, f or "plain").text() for o, f in zip(text_bytes(b.column(at_out)), b.column(at_form).to_pylist())]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary()).cast(pa.string())], [f.name for f in schema.fields])

    return map_arrow(kept, run, schema)


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Lengths, form and digests of every document's output and of the text restored from it."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_pylist()
        made = [make(k, t, seed) for k, t in zip(ids, text_bytes(b.column(1)))]
        back = [restored(m.table.text(), m.form).sha256() for m in made]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([m.n for m in made], pa.int64()), pa.array([m.form for m in made]),
             pa.array([m.prefix_chars for m in made], pa.int64()), pa.array([m.middle_chars for m in made], pa.int64()),
             pa.array([m.table.sha256() for m in made]), pa.array(back)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                     "output_sha256 string, restored_sha256 string")
