"""Alignment of two tokenizers' ids over the same bytes (operator 12).

Per Arrow batch, all in Arrow: the id lists of both tokenizers are flattened, parent
indices say whose document an id is, a segmented cumulative sum of token byte lengths gives
every token's end within its document, and an Acero hash join on (document, end) finds
where tokens of both end together.  Such an end is a link of its two tokens and closes a
group.  Partial counts of linked id pairs come from ``Table.group_by`` and are merged by
Spark; a second narrow pass scores every document's links with the merged counts.

Encoding: byte-level pre-tokens and sentence pieces both break where a blank follows a
character that is no white space, so each distinct stretch between such places is encoded
once a worker (``CACHE``) and a document's ids are joined from them.  Tests compare with
whole-text encoding.

Counts grow with the corpus, so they are not broadcast whole: pairs with over 1/HOT_SHARE
of all links (fewer than HOT_SHARE pairs whatever the input) are looked up in place, and
the links of all others, few by their rarity, meet their counts in a shuffle join.

Defined cases: a null or empty text, and one whose token bytes do not give it back (it
holds U+2581), has no tokens: zeros and an empty ``groups_sha256``; repeated ids each get
their row and count as often; an empty table gives an empty result; other columns are not
read.  Very long texts are one row; batches are cut by bytes (``SLICE_BYTES``).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, prepare

CACHE = 200_000  # stretches a worker keeps
TOGETHER = 1000  # stretches encoded at once
SLICE_BYTES = 1 << 20
PARTIAL_ROWS = 1 << 20  # links counted together before their partial counts are passed on
HOT_SHARE = 1 << 20
BLANK = "\u2581"  # how pieces write a blank

_SPLIT = re.compile(r"(?<=\S) ")
# a blank that follows white space or begins the text does not part stretches (Python's isspace, in RE2)
_LOOSE = (r"^ |[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 is itself, the others follow from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# How a byte-level vocabulary of this kind cuts a text before merging (a FIXED VALUE of its published definition).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_encoder(a_json: str):
    """Ids of a text by the tokenizers file; special tokens' strings are plain text.

    When the file is a plain byte-level one whose ids follow its merges, the ids are ranks,
    and the rank encoder gives the same ids at a quarter of the time.
    """
    spec = json.loads(a_json)
    vocabulary, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
    cutter = {k: v for k, v in (spec["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
    special = {t["content"] for t in spec["added_tokens"]}
    if (spec["normalizer"] is None and cutter == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
            and not any(spec["model"].get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges"))
            and all(vocabulary[x + y] == 256 + i for i, (x, y) in enumerate(merges))):
        import tiktoken
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): k for t, k in vocabulary.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer
    plain = Tokenizer.from_str(a_json)
    plain.encode_special_tokens = True
    return lambda text: plain.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pair:
    """Both tokenizers of a worker: token bytes, and ids of stretches of text."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        self.a = byte_level_encoder(a_json)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec = json.loads(a_json)
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k)
                        else self.b.id_to_piece(k).replace(BLANK, " ").encode() for k in range(self.b.get_piece_size())]
        self.a_lengths = pa.array([len(x) for x in self.a_bytes], pa.int64())
        self.b_lengths = pa.array([len(x) for x in self.b_bytes], pa.int64())
        self.a_names = pa.array([str(k) for k in range(len(self.a_bytes))])
        self.b_names = pa.array([str(k) for k in range(len(self.b_bytes))])
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.used: set[str] = set()   # stretches met again since the cache was last thinned
        self.wrong: set[str] = set()  # stretches that their tokens do not give back

    def _learn(self, stretches: list[str]) -> None:
        """Encode distinct stretches, many at once: their tokens part at the stretches' last bytes."""
        alone = [x for x in stretches if not x or x[-1].isspace()]
        plain = [x for x in stretches if x and not x[-1].isspace()]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at:at + TOGETHER]
            text = " ".join(part)
            whole = b" " + text.encode()
            stops = np.cumsum([len(x.encode()) + 1 for x in part])
            a = self._parted(self.a(" " + text), self.a_bytes, self.a_lengths, whole, stops)
            b = self._parted(self.b.encode(text, num_threads=1), self.b_bytes, self.b_lengths, whole, stops)
            if a and b:
                self.known.update(zip(part, zip(a, b)))
            else:
                alone += part
        for x in alone:
            ia = self.a(" " + x)
            ib = self.b.encode(x, num_threads=1) if x else [self.b.piece_to_id(BLANK)]  # of nothing it gives nothing
            self.known[x] = np.asarray(ia, "<i4").tobytes(), np.asarray(ib, "<i4").tobytes()
            data = b" " + x.encode()
            if b"".join([self.a_bytes[k] for k in ia]) != data or b"".join([self.b_bytes[k] for k in ib]) != data:
                self.wrong.add(x)

    @staticmethod
    def _parted(ids: list[int], tokens: list[bytes], lengths: pa.Array, whole: bytes, stops: np.ndarray) -> list[bytes] | None:
        """The ids of each stretch; None when the tokens do not give the text back."""
        if b"".join(map(tokens.__getitem__, ids)) != whole:
            return None
        ids = np.asarray(ids, "<i4")
        last = np.searchsorted(np.cumsum(lengths.to_numpy()[ids]), stops) + 1
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * np.append(0, last[:-1])).tolist(), (4 * last).tolist())]

    def _thin(self) -> None:
        """Forget the stretches met in one slice only."""
        kept = self.used if len(self.used) < CACHE // 2 else set()
        self.known = {w: self.known[w] for w in kept}
        self.used, self.wrong = set(), self.wrong & kept

    def encode(self, batch: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of each text by both; none where there are no tokens."""
        if len(self.known) > CACHE:
            self._thin()
        split = pc.split_pattern(batch, " ")
        loose = np.flatnonzero(pc.match_substring_regex(batch, _LOOSE).to_numpy(zero_copy_only=False))
        if len(loose):
            again = pa.array([_SPLIT.split(t) for t in batch.take(pa.array(loose)).to_pylist()], split.type)
            order = np.arange(len(batch))
            order[loose] = len(batch) + np.arange(len(loose))
            split = pa.concat_arrays([split, again]).take(pa.array(order))
        coded = split.flatten().dictionary_encode()
        stretches, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        parents = pc.list_parent_indices(split).to_numpy()
        known = self.known
        new = [w for w in stretches if w not in known]
        self.used.update(stretches)
        self.used.difference_update(new)
        self._learn(new)
        none = pc.equal(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        if self.wrong:
            none = none.copy()
            none[parents[np.array([w in self.wrong for w in stretches])[which]]] = True
        if none.any():
            which, parents = which[~none[parents]], parents[~none[parents]]
        ids = [known[w] for w in stretches]
        return tuple(_gather([x[k] for x in ids], which, parents, len(batch)) for k in (0, 1))


def _gather(ids: list[bytes], which: np.ndarray, parents: np.ndarray, n: int) -> pa.ListArray:
    """Lists of ids of ``n`` documents whose stretches are ``which`` of those in ``ids``."""
    flat = lists(ids).take(pa.array(which))
    sizes = np.bincount(parents, weights=pc.list_value_length(flat).to_numpy(), minlength=n).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat.flatten())


def lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def ends(ids: pa.ListArray, lengths: pa.Array) -> pa.Table:
    """(doc, end, at) of every token: its document, its end byte there, and its place among all tokens."""
    parents = pc.list_parent_indices(ids)
    running = pc.cumulative_sum(pc.take(lengths, ids.flatten()))
    # bytes before each document: the running sum at the list's first token
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), running]), pc.cast(ids.offsets, pa.int64()))
    return pa.table({"doc": pc.cast(parents, pa.int32()), "end": pc.cast(pc.subtract(running, pc.take(before, parents)), pa.int32()),
                     "at": pa.array(np.arange(len(parents), dtype=np.int32))})


def links(a: pa.ListArray, b: pa.ListArray, a_lengths: pa.Array, b_lengths: pa.Array) -> pa.Table:
    """(doc, at_a, at_b, a, b) of all pairs of tokens that end together, in the order of the text."""
    found = ends(a, a_lengths).rename_columns(["doc", "end", "at_a"]).join(
        ends(b, b_lengths).rename_columns(["doc", "end", "at_b"]), keys=["doc", "end"], join_type="inner", use_threads=False)
    found = found.sort_by([("at_a", "ascending"), ("at_b", "ascending")]).combine_chunks()
    return found.append_column("a", pc.take(a.flatten(), found["at_a"])).append_column("b", pc.take(b.flatten(), found["at_b"]))


def joined(ids: pa.ListArray, names: pa.Array, last: np.ndarray) -> pa.Array:
    """Decimal ids of each group, comma-joined; ``last`` are the places of the groups' last tokens."""
    offsets = pa.array(np.concatenate(([0], last + 1)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(names, ids.flatten())), ",")


def aligned(pair: Pair, batch: pa.Array) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups, link_a, link_b of every text."""
    ia, ib = pair.encode(batch)
    found = links(ia, ib, pair.a_lengths, pair.b_lengths)
    doc, at_a, at_b = (found[c].to_numpy() for c in ("doc", "at_a", "at_b"))
    per_doc = np.bincount(doc, minlength=len(batch))
    # an end closes one group, however many links it has
    closes = np.flatnonzero(np.append((at_a[1:] != at_a[:-1]) & (at_b[1:] != at_b[:-1]), True)) if len(doc) else np.zeros(0, np.int64)
    groups = pc.binary_join_element_wise(joined(ia, pair.a_names, at_a[closes]), joined(ib, pair.b_names, at_b[closes]), "|")
    n_groups = np.bincount(doc[closes], minlength=len(batch))
    offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    of_doc = offsets(per_doc)
    return [pc.list_value_length(ia).cast(pa.int64()), pc.list_value_length(ib).cast(pa.int64()), pa.array(n_groups, pa.int64()),
            pa.array(per_doc, pa.int64()), pc.binary_join(pa.ListArray.from_arrays(offsets(n_groups), groups), ";"),
            pa.ListArray.from_arrays(of_doc, found["a"].combine_chunks()), pa.ListArray.from_arrays(of_doc, found["b"].combine_chunks())]


def _slices(ids: pa.Array, column: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows of at most about SLICE_BYTES of text, a longer text alone; null texts are empty."""
    column = pc.fill_null(column, "")
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if held and held + n > SLICE_BYTES:
            yield ids.slice(at, i - at), column.slice(at, i - at)
            at, held = i, 0
        held += n
    yield ids.slice(at), column.slice(at)


_PAIRS: dict[str, Pair] = {}


def align(docs: DataFrame, a_file: str, b_file: str, with_groups: bool = True) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (optional), link_a, link_b.

    ``groups`` is the written form ``a1,a2|b1;a3|b2,b3``; link_a and link_b are parallel
    lists of the linked ids, in order.  A narrow step.
    """
    prepare(docs.sparkSession)
    with open(a_file, encoding="utf-8") as fa, open(b_file, "rb") as fb:
        source = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))  # as large as the vocabularies
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups, "link_a", "link_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        key = hashlib.sha256(source.value[0].encode() + source.value[1]).hexdigest()
        if key not in _PAIRS:
            _PAIRS[key] = Pair(*source.value)
        pair = _PAIRS[key]
        for batch in batches:
            if not batch.num_rows:
                continue
            for ids, part in _slices(batch.column(0), batch.column(1)):
                n_a, n_b, n_groups, n_links, groups, la, lb = aligned(pair, part)
                digests = pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for k, g in zip(n_a.to_pylist(), groups)])
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, n_groups, n_links, digests, *[groups] * with_groups, la, lb], names)

    types = {"doc_id": "long", "groups_sha256": "string", "groups": "string", "link_a": "array<int>", "link_b": "array<int>"}
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, ", ".join(f"{n} {types.get(n, 'long')}" for n in names)))


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(a, b, count) of every linked id pair of the corpus: partial counts a task, merged by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def counted() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            yield from t.select(["a", "b", "n_sum"]).rename_columns(["a", "b", "n"]).to_batches()

        for batch in batches:
            a, b = batch.column(0).flatten(), batch.column(1).flatten()
            held.append(pa.table({"a": a, "b": b, "n": pa.array(np.ones(len(a), np.int64))}))
            rows += len(a)
            if rows >= PARTIAL_ROWS:
                # pairs repeat: fold what is held, pass it on only when the folded rows are many
                folded = pa.Table.from_batches(list(counted()), held[0].schema)
                held, rows = [folded], folded.num_rows
                if rows >= PARTIAL_ROWS // 2:
                    yield from folded.to_batches()
                    held, rows = [], 0
        if held:
            yield from counted()

    partial = alignments.select("link_a", "link_b").mapInArrow(run, "a int, b int, n long")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("count"))


def mapping(counts: DataFrame) -> DataFrame:
    """``counts`` with best: the pair's count is the highest of its B id (ties included)."""
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # one row an id of B's vocabulary
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def scored(alignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """``alignments`` (a materialized table) without the link lists, with n_best and count_sum.

    ``pairs`` is the materialized result of ``mapping``.
    """
    spark = alignments.sparkSession
    total = pairs.agg(F.sum("count")).first()[0] or 0
    limit = total // HOT_SHARE
    # every hot pair holds more than 1/HOT_SHARE of all links, so there are fewer than HOT_SHARE
    hot = pairs.filter(F.col("count") > limit).select(
        (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("k"), "count", "best").toPandas().sort_values("k")
    table = spark.sparkContext.broadcast((hot["k"].to_numpy(np.int64), hot["count"].to_numpy(np.int64), hot["best"].to_numpy(bool)))
    kept = [c for c in alignments.columns if c not in ("link_a", "link_b")]
    rows = alignments.select(*kept, "link_a", "link_b")
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            la, lb = batch.column(at), batch.column(at + 1)
            k = la.flatten().to_numpy().astype(np.int64) << 32 | lb.flatten().to_numpy()
            doc = pc.list_parent_indices(la).to_numpy()
            place = np.searchsorted(keys, k)
            place[place == len(keys)] = 0
            seen = keys[place] == k if len(keys) else np.zeros(len(k), bool)
            n, hit, d = batch.num_rows, place[seen], doc[seen]
            # sums by document, in whole numbers
            totals = np.zeros(n, np.int64)
            np.add.at(totals, d, counts[hit])
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[~seen], minlength=n)))).astype(np.int32)),
                                            pa.array(k[~seen]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(np.bincount(d, weights=best[hit], minlength=n).astype(np.int64)), pa.array(totals), rest],
                [*kept, "n_best", "count_sum", "rest"])

    schema = alignments.select(*kept).schema.add("n_best", "long").add("count_sum", "long").add("rest", T.ArrayType(T.LongType()))
    part = materialize(rows.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "aligned-part")
    rare = pairs.filter(F.col("count") <= limit).select(
        (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("k"), "count", "best")
    # a rare pair has at most ``limit`` links, so no key of this join is hot
    more = (part.select("__row", F.explode("rest").alias("k")).join(rare, "k").groupBy("__row")
            .agg(F.count_if("best").alias("__best"), F.sum("count").alias("__sum")))
    return (part.drop("rest").join(more, "__row", "left")
            .select(*kept, (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum")))


def report(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    prepare(docs.sparkSession)
    alignments = materialize(align(docs, a_file, b_file, with_groups=False), "alignments")
    counts = materialize(pair_counts(alignments), "pair-counts")
    pairs = materialize(mapping(counts), "pairs")
    out = scored(alignments, pairs)
    discard(alignments, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
