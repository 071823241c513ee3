"""WARC archives as a chunked record table (operator 1).

Records travel as rows (record_id, chunk_no, data) of bounded size.  The writer streams
the chunks of a partition into ``.warc.gz`` files (one gzip member per record) and carries
the payload's SHA-1 from chunk to chunk; the reader streams a file back into chunk rows
that carry the digest and length of all chunks so far.  Neither holds a whole record.

Equal payloads (SHA-1 and length) of at least ``min_revisit`` bytes are stored once: the
page with the smallest id is the response, the others are revisits that refer to it.

Writers put files under a new shared folder, with a name per attempt, and report them in a
manifest table; only files in the manifest are read, so a task that is repeated after an
executor loss leaves an unread file at worst.

Defined cases: a null payload is empty; repeated rows with the smallest id are all
responses; a null ``page_id`` is a response only if no page with an id has its payload; a
null ``url`` is written as an empty target; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize, prepare, shared_path

CHUNK = 1 << 20
MIN_REVISIT = 0
FILE_BYTES = 1 << 28
DATE = "2000-01-01T00:00:00Z"
_URN = "urn:x-page:"
_LENGTH = "X-Payload-Length"  # revisits carry no payload, so its length is a field of its own


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes are eight base-32 digits."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decided(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", base32_sha1(F.col("payload")))
    slim = materialize(rows.select("page_id", "payload_bytes", "payload_digest"), "digests")
    first = materialize(slim.groupBy("payload_digest", "payload_bytes")
                        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")), "first")
    joined = join_lookup(rows, first, ["payload_digest", "payload_bytes"], "n", slim.count())
    revisit = ((F.col("payload_bytes") >= min_revisit) & F.col("first_id").isNotNull()
               & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first_id")).alias("refers_to"))


def chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a record, in order; a record without bytes to store has one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.ceil(stored / chunk) - 1, F.lit(0)).cast("int")
    return (records.withColumn("last_no", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last_no"))))
            .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", "last_no",
                    F.when(F.col("record_type") == "response",
                           F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).alias("data")))


def _line(x) -> str:
    return str("" if x is None else x).replace("\r", "%0D").replace("\n", "%0A")


def _head(r: dict) -> bytes:
    """Headers of a record: WARC fields, then the HTTP headers that begin its block."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {r['payload_bytes']}\r\n\r\n").encode()
    response = r["record_type"] == "response"
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{_URN}{'' if r['page_id'] is None else r['page_id']}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", _line(r["url"])),
              ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), (_LENGTH, r["payload_bytes"])]
    if not response:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{_URN}{r['refers_to']}>")]
    fields += [("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", len(http) + (r["payload_bytes"] if response else 0))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def _digest(h) -> str:
    return base64.b32encode(h.digest()).decode()


class Writer:
    """Streams chunk rows into WARC files and lists the files."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.file_bytes = folder, file_bytes
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.files = None, []
        self.member = self.sha = None

    def _open(self) -> None:
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)
        self.files.append([f"{self.uri}/{name}", 0, 0])

    def close(self) -> None:
        if self.out is not None:
            self.files[-1][2] = self.out.tell()
            self.out.close()
            self.out = None

    def chunk(self, r: dict) -> None:
        if r["chunk_no"] == 0:
            if self.out is None:
                self._open()
            self.member = gzip.GzipFile(fileobj=self.out, mode="wb", compresslevel=1, mtime=0)
            self.member.write(_head(r))
            self.sha = hashlib.sha1()
        data = r["data"] or b""
        self.sha.update(data)
        self.member.write(data)
        if r["chunk_no"] == r["last_no"]:
            if r["record_type"] == "response" and _digest(self.sha) != r["payload_digest"]:
                raise ValueError(f"chunks of page {r['page_id']} do not add up to its payload")
            self.member.write(b"\r\n\r\n")
            self.member.close()
            self.files[-1][1] += 1
            if self.out.tell() >= self.file_bytes:
                self.close()


def write(chunk_rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (path, records, bytes)."""
    folder = shared_path(chunk_rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None
        for b in batches:
            w = w or Writer(folder, file_bytes)
            for k in range(b.num_rows):
                w.chunk({name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)})
        if w:
            w.close()
            path, records, size = zip(*w.files)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(records, pa.int64()), pa.array(size, pa.int64())],
                                             ["path", "records", "bytes"])

    return materialize(chunk_rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_file(stream, chunk: int) -> Iterator[dict]:
    """Chunk rows of a decompressed WARC stream: each carries the length and digest of the payload so far."""
    f = io.BufferedReader(stream, 1 << 16)
    number = 0
    while line := f.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"record {number}: {line[:40]!r} does not begin a record")
        fields = {}
        while (line := f.readline()) != b"\r\n":
            k, _, v = line.decode().partition(": ")
            fields[k] = v[:-2]
        left = int(fields["Content-Length"])
        while True:  # the HTTP headers of the block
            line = f.readline()
            left -= len(line)
            if line == b"\r\n":
                break
        ident = lambda name: int(x) if (x := fields.get(name, "")[1 + len(_URN):-1]) else None
        row = {"record_no": number, "page_id": ident("WARC-Record-ID"), "record_type": fields["WARC-Type"],
               "refers_to": ident("WARC-Refers-To"), "target": fields["WARC-Target-URI"]}
        sha, size, no = hashlib.sha1(), 0, 0
        if row["record_type"] == "revisit":
            yield row | {"chunk_no": 0, "data": None, "last": True, "payload_bytes": int(fields[_LENGTH]),
                         "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
        else:
            while True:
                data = f.read(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError(f"record {number} is cut short")
                left -= len(data)
                sha.update(data)
                size += len(data)
                if not left and f"sha1:{_digest(sha)}" != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"record {number}: the payload does not match its digest")
                yield row | {"chunk_no": no, "data": data, "last": not left, "payload_bytes": size, "payload_digest": _digest(sha)}
                no += 1
                if not left:
                    break
        if f.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} does not end as it should")
        number += 1


_READ = [("path", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("target", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()),
         ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def read(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in the manifest; one task a file."""
    names = [n for n, _ in _READ]
    batch_rows = max(1, (8 << 20) // chunk) if with_data else 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for row in read_file(plain, chunk):
                        row["path"] = path
                        if not with_data:
                            row["data"] = None
                        rows.append(row)
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _READ], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _READ], names)

    files = manifest.count()
    return (manifest.select("path").repartition(max(1, files), "path")
            .mapInArrow(run, "path string, record_no long, page_id long, record_type string, refers_to long, "
                             "target string, chunk_no long, data binary, last boolean, payload_bytes long, payload_digest string"))


def report(pages: DataFrame, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages to archives, read them back: one row per record."""
    prepare(pages.sparkSession)
    manifest = write(chunks(decided(pages, min_revisit), chunk))
    return read(manifest, chunk, with_data=False).filter("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
