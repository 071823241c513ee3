"""Token ids in wavelet matrices, one compressed file per shard (operator 3).

Documents are dealt by ranges of ``doc_id`` and sorted, so each task holds a contiguous
run; it encodes whole texts, appends the end id, and writes shards of at most about
``SHARD_TOKENS`` ids.  A shard stores the ids bit by bit, highest first: each plane holds
one bit of every id, and the ids are stably parted by it before the next plane.  With a
directory of ranks per 512 bits this gives access, counting and the k-th occurrence of a
token from the compressed file alone; planes are compressed in frames, so a lookup unpacks
one frame a plane.

Encoding: no token of this tokenizer crosses ASCII white space, so each distinct word is
encoded once: Arrow splits a batch and numbers its distinct words, and the words' ids are
taken by these numbers.  The word cache is bounded (``CACHE_WORDS``).  Words of lower-case Latin-1 letters, digits and
ASCII signs are merged by rank where the file allows it (``by_rank``), all others by the
tokenizers library; tests compare both with whole-text encoding.

Defined cases: a null text is empty and holds the end id alone; a null ``doc_id`` sorts
first; repeated ids follow each other, ordered by text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import byte_alphabet
from .common import materialize, prepare, shared_path, text_bytes

END_ID = 1
SHARD_TOKENS = 1 << 23
CACHE_WORDS = 1_200_000
TOGETHER_BYTES = 8 << 20  # text encoded together, whose distinct words are looked up once
MAGIC = b"FXWVMTX1"
BLOCK = 512  # bits per entry of the rank directory
FRAME = 1 << 16  # bytes of a plane compressed together


# ---------------------------------------------------------------- encoding

# What the rank encoder stands for: the published definition of this tokenizer (FIXED VALUES).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

MARK = "\x01"  # stands for the end of a pre-token; no word of the rank encoder holds it
# Words that no normaliser changes and that hold no apostrophe (contractions) and no "<" (special tokens),
# and how such a word is cut into pre-tokens.
_SIMPLE = re.compile(r"[!-&(-;=-@\[-~\xdf-\xf6\xf8-\xff]+")
_PARTS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\n]+")


def by_rank(source: str) -> bool:
    """Whether merging by the rank of the joined bytes gives the file's ids.

    It does when the ids follow the merges, every merge joins tokens of lower ids, and every
    token is reached from its own bytes by the merges before it: then at a token's turn its
    bytes stand as the two parts of its merge wherever no merge crossed their ends.
    """
    spec = json.loads(source)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    if (spec["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZERS} or not suffix
            or cut[0].get("pattern") != {"Regex": WORD_PATTERN} or not cut[0].get("invert") or cut[0].get("behavior") != "Removed"
            or [{k: v for k, v in c.items() if k != "trim_offsets"} for c in cut[1:]]
            != [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))):
        return False
    vocabulary = model["vocab"]
    special = {t["content"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = {pair: vocabulary.get("".join(pair)) for pair in merges}
    if (sorted(vocabulary[c] for c in alphabet) + sorted(vocabulary[c + suffix] for c in alphabet) != list(range(512))
            or list(ids.values()) != list(range(512, 512 + len(merges)))
            or len(vocabulary.keys() - special) != 512 + len(merges)
            or any(max(vocabulary[x], vocabulary[y]) >= k for (x, y), k in ids.items())):
        return False
    for pair, k in ids.items():
        token = "".join(pair)
        end = len(token) - len(suffix) if token.endswith(suffix) else len(token)
        state = list(token[:end])
        if end < len(token):
            state[-1] += suffix
        while len(state) > 2:
            rank, at = min((ids.get(p, k), i) for i, p in enumerate(zip(state, state[1:])))
            if rank >= k:
                return False
            state[at:at + 2] = [state[at] + state[at + 1]]
        if tuple(state) != pair:
            return False
    return True


class Encoder:
    """ids of whole texts as little-endian 16- or 32-bit integers, from the text of a tokenizers file.

    ``ranked``: what ``by_rank`` says of it.
    """

    def __init__(self, source: str, ranked: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(source)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.words: dict[bytes, bytes] = {}
        self.ranks = None
        if ranked:
            import tiktoken
            model, alphabet = json.loads(source)["model"], byte_alphabet()
            suffix, special = model["end_of_word_suffix"], set(self.tokenizer.get_added_tokens_decoder())
            ranks = {}
            for token, k in model["vocab"].items():
                if k not in special:
                    end = token.endswith(suffix)
                    raw = bytes(alphabet[c] for c in (token.removesuffix(suffix) if end else token))
                    ranks[raw + MARK.encode() if end else raw] = k
            self.line = ranks[b"\n"]
            self.ranks = tiktoken.Encoding("ranks", pat_str=f"[^{MARK}\n]+{MARK}|\n", mergeable_ranks=ranks,
                                           special_tokens={}).encode_ordinary

    def _learn(self, keys: list[bytes]) -> None:
        """Encode words without white space and keep their ids."""
        decoded = [k.decode(errors="replace") for k in keys]
        rest = range(len(keys))
        if self.ranks:
            simple = [_SIMPLE.fullmatch(t) is not None for t in decoded]
            plain = [i for i in rest if simple[i]]
            rest = [i for i in rest if not simple[i]]
            size = self.dtype.itemsize
            for at in range(0, len(plain), 1000):
                part = plain[at:at + 1000]
                block = _PARTS.sub("\\g<0>" + MARK, "\n".join([decoded[i] for i in part]))
                ids = np.array(self.ranks(block), self.dtype)
                raw = ids.tobytes()
                ends = (np.flatnonzero(ids == self.line) * size).tolist()
                self.words.update(zip([keys[i] for i in part],
                                      [raw[a:b] for a, b in zip([0, *(e + size for e in ends)], [*ends, len(raw)])]))
        for i, e in zip(rest, self.tokenizer.encode_batch([decoded[i] for i in rest], add_special_tokens=False)):
            self.words[keys[i]] = np.asarray(e.ids, self.dtype).tobytes()

    def encode(self, datas: list[bytes]) -> list[bytes]:
        # the tokenizer lower-cases too; only the names of its special tokens are matched before
        lower = pa.array([d if b"<|" in d else d.lower() for d in datas], pa.large_binary())
        lists = pc.ascii_split_whitespace(lower.view(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        cuts, flat = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1).tolist(), bytes(distinct.buffers()[2] or b"")
        words = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        known = self.words
        ids = list(map(known.get, words))
        new = [w for w, x in zip(words, ids) if x is None]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = words
            self._learn(new)
            ids = list(map(known.__getitem__, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        values = pa.array(np.frombuffer(b"".join(ids), self.dtype))
        raw = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), values).take(coded.indices)
        raw = memoryview(raw.flatten().to_numpy()).cast("B")
        ends = np.concatenate(([0], np.cumsum(sizes[at])))[lists.offsets.to_numpy()]
        ends = (ends * self.dtype.itemsize).tolist()
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(source: str, ranked: bool = False) -> Encoder:
    """One encoder, with its cache, per worker process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        _ENCODERS[key] = Encoder(source, ranked)
    return _ENCODERS[key]


# ---------------------------------------------------------------- the file

def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes, highest bit first, and the number of zeros of each."""
    planes, zeros = [], []
    a = ids
    for level in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << level)) != 0
        planes.append(np.packbits(one, bitorder="little"))
        z = len(a) - int(np.count_nonzero(one))
        parted = np.empty_like(a)
        np.compress(one, a, out=parted[z:])
        np.compress(np.logical_not(one, out=one), a, out=parted[:z])
        zeros.append(z)
        a = parted
    return planes, zeros


def dump(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A shard: frames of the planes, rank directories, documents, then a footer that says where they are."""
    pack = zstandard.ZstdCompressor(level=1).compress
    out, at, where = [MAGIC], len(MAGIC), {"n": len(ids), "bits": bits, "planes": []}

    def put(raw: bytes) -> list[int]:
        nonlocal at
        z = pack(raw)
        out.append(z)
        at += len(z)
        return [at - len(z), len(z)]

    planes, zeros = build(ids, bits)
    for plane, z in zip(planes, zeros):
        whole = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        whole[:len(plane)] = plane
        ones = np.bitwise_count(whole.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate((np.zeros(1, "<u4"), np.cumsum(ones, dtype="<u4")))
        where["planes"].append({"zeros": z, "ranks": put(ranks.tobytes()),
                                "frames": [put(whole[i:i + FRAME].tobytes()) for i in range(0, len(whole), FRAME)]})
    where["docs"] = put(json.dumps(doc_ids).encode())
    where["lengths"] = put(np.array(lengths, "<i8").tobytes())
    foot = pack(json.dumps(where).encode())
    return b"".join([*out, foot, struct.pack("<q", len(foot)), MAGIC])


class Shard:
    """Queries on a shard file (a seekable binary file object)."""

    def __init__(self, f):
        self.f = f
        self.unpack = zstandard.ZstdDecompressor().decompress
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 16)
        size, magic = struct.unpack("<q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(end - 16 - size)
        self.at = json.loads(self.unpack(f.read(size)))
        self.n, self.bits = self.at["n"], self.at["bits"]
        self.kept: dict = {}

    def _get(self, where: list[int]) -> bytes:
        self.f.seek(where[0])
        return self.unpack(self.f.read(where[1]))

    def _ranks(self, level: int) -> np.ndarray:
        if ("r", level) not in self.kept:
            self.kept["r", level] = np.frombuffer(self._get(self.at["planes"][level]["ranks"]), "<u4")
        return self.kept["r", level]

    def _block(self, level: int, block: int) -> np.ndarray:
        """The bits of one block."""
        frame, rest = divmod(block * (BLOCK // 8), FRAME)
        if (level, frame) not in self.kept:
            self.kept[level, frame] = np.frombuffer(self._get(self.at["planes"][level]["frames"][frame]), np.uint8)
        return np.unpackbits(self.kept[level, frame][rest:rest + BLOCK // 8], bitorder="little")

    def _rank(self, level: int, bit: int, pos: int) -> int:
        """Number of ``bit`` among the first ``pos`` bits of a plane."""
        block, rest = divmod(pos, BLOCK)
        ones = int(self._ranks(level)[block]) + (int(self._block(level, block)[:rest].sum()) if rest else 0)
        return ones if bit else pos - ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th ``bit`` (from 0) of a plane."""
        ranks = self._ranks(level).astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[k - int(ranks[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            block, rest = divmod(i, BLOCK)
            bit = int(self._block(level, block)[rest])
            value = value << 1 | bit
            i = self._rank(level, bit, i) + (self.at["planes"][level]["zeros"] if bit else 0)
        return value

    def _down(self, token: int, pos: int) -> int:
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            pos = self._rank(level, bit, pos) + (self.at["planes"][level]["zeros"] if bit else 0)
        return pos

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` among the ids lo to hi."""
        if token >> self.bits:
            return 0
        return self._down(token, self.n if hi is None else hi) - self._down(token, lo)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``token``; IndexError beyond the last."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        pos = self._down(token, 0) + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            pos = self._select(level, bit, pos - (self.at["planes"][level]["zeros"] if bit else 0))
        return pos

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane = self.at["planes"][level]
            raw = np.frombuffer(b"".join(self._get(x) for x in plane["frames"]), np.uint8)
            one = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(a)
            before[~one] = a[:plane["zeros"]]
            before[one] = a[plane["zeros"]:] | kind(1 << (self.bits - 1 - level))
            a = before
        return a

    def documents(self) -> tuple[list, np.ndarray]:
        return json.loads(self._get(self.at["docs"])), np.frombuffer(self._get(self.at["lengths"]), "<i8")


# ---------------------------------------------------------------- Spark

def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards; returns the manifest (part, seq, path, n_docs, n_tokens), ordered by part and seq."""
    from pyspark import TaskContext
    folder = shared_path(docs.sparkSession, "wavelet")
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    ranked = by_rank(source)
    source = docs.sparkSession.sparkContext.broadcast(source)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(source.value, ranked)
        end = np.array([end_id], enc.dtype).tobytes()
        bits = max(1, (max(enc.size, end_id + 1) - 1).bit_length())
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, seq
            system, top = fs.FileSystem.from_uri(folder)
            system.create_dir(top, recursive=True)
            name = f"shard-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.wm"
            lengths = [len(x) // enc.dtype.itemsize for x in ids]
            data = dump(names, lengths, np.frombuffer(b"".join(ids), enc.dtype), bits)
            with system.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([f"{folder}/{name}"]),
                                              pa.array([len(names)]), pa.array([sum(lengths)])],
                                             ["part", "seq", "path", "n_docs", "n_tokens"])
            names, ids, held, seq = [], [], 0, seq + 1
            return row

        def together() -> Iterator[tuple[list, list[bytes]]]:
            """Keys and texts of batches, about ``TOGETHER_BYTES`` of text at a time."""
            keys, datas, size = [], [], 0
            for b in batches:
                new = text_bytes(b.column(1))
                keys += b.column(0).to_pylist()
                datas += new
                size += sum(map(len, new))
                if size >= TOGETHER_BYTES:
                    yield keys, datas
                    keys, datas, size = [], [], 0
            yield keys, datas

        for keys, datas in together():
            for k, x in zip(keys, enc.encode(datas)):
                names.append(k)
                ids.append(x + end)
                held += len(x) // enc.dtype.itemsize + 1
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
             .sortWithinPartitions("doc_id", "text"))
    return materialize(dealt.mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"), "shards")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    # one row a shard: the running total needs no more than the list of files
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    shard = Shard(f)
                    ids, (names, lengths) = shard.decode(), shard.documents()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e].astype("<u4").tobytes()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + ends - lengths, pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    return (based.select("path", "base").repartition(max(1, files), "path")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    prepare(docs.sparkSession)
    return read(write(docs, tokenizer))
