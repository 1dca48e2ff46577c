"""WARC archives through a chunked record table.

A payload of any size is rows ``(uid, chunk_no, data)`` that stream through the writer and the reader;
neither holds a whole record. Each chunk row carries the digests of the payload up to its end, so the
last row has the payload's own. Equal payloads (SHA-256 and length) make one ``response`` and further
``revisit`` records. Archives are gzip members, one a record, written to the shared folder through
pyarrow's file systems; a file counts only if the manifest, itself written by Spark, lists it, so
files of lost or repeated task attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, columns_as

CHUNK = 1 << 18
ROLL = 1 << 30
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = "uid long, page_id long, url string, n_bytes long, chunk_no long, last boolean, data binary, sha1 binary, sha256 binary"
RECORD_SCHEMA = "uid long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, last boolean, data binary"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``size`` bytes of data."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_CHUNKS = pa.schema([("uid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("n_bytes", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1", pa.binary()), ("sha256", pa.binary())])
_RECORDS = pa.schema([("uid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("data", pa.binary())])
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("n_bytes", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):  # few chunks at a time become Python objects
            part = batch.slice(k, 64)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        sha1 = sha256 = None
        for uid, page_id, url, n_bytes, chunk_no, last, data in _rows(batches):
            if chunk_no == 0:
                sha1, sha256 = hashlib.sha1(usedforsecurity=False), hashlib.sha256()
            sha1.update(data)
            sha256.update(data)
            yield uid, page_id, url, n_bytes, chunk_no, last, data, sha1.copy().digest(), sha256.copy().digest()

    return _batches(rows(), _CHUNKS)


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """``pages``: page_id, url, payload (binary). One row a chunk; an empty payload has one empty chunk.

    The result must be written before ``uid`` is used to join: it numbers the rows of this run.
    """
    n = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    chunks = F.greatest(F.ceil(n / chunk_bytes), F.lit(1)).cast("long")
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", n.alias("n_bytes"), chunks.alias("chunks"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk_no"))
    data = F.substring(F.col("payload"), (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    rows = rows.select("uid", "page_id", "url", "n_bytes", "chunk_no", (F.col("chunk_no") == F.col("chunks") - 1).alias("last"), data.alias("data"))
    return rows.mapInArrow(_digested, CHUNK_SCHEMA)


def roles(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of each record: its digests, whether it is a response or a revisit, and of which record."""
    whole = chunks.where("last").select("uid", "page_id", "n_bytes", "sha1", "sha256")
    first = whole.where(F.col("n_bytes") >= min_bytes).groupBy("sha256", "n_bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")).alias("first"))
    both = whole.join(first, ["sha256", "n_bytes"], "left")
    return both.select("uid", "sha1", F.coalesce(F.col("first.uid") != F.col("uid"), F.lit(False)).alias("revisit"), F.col("first.page_id").alias("refers_to"), F.col("first.uid").alias("refers_uid"))


def _record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{uid}>"


def _write_archives(root: str, date: str, level: int, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, path, records, size, done = None, "", 0, 0, []
        squeeze, skip = None, False

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        def end_record() -> None:
            nonlocal squeeze, records
            if squeeze:
                put(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                squeeze, records = None, records + 1

        for uid, page_id, url, n_bytes, chunk_no, data, digest, revisit, refers_to, refers_uid in _rows(batches):
            if chunk_no < 0:
                end_record()
                if out and size >= roll:
                    out.close()
                    done.append((path, records, size))
                    out = None
                if not out:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{path}", compression=None)
                http = HTTP.format(n_bytes)
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, uid)), ("WARC-Date", date)]
                fields += [("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~"))] if url is not None else []
                fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("X-Payload-Length", n_bytes)]
                fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, refers_uid))] if revisit else []
                fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if revisit else n_bytes))]
                squeeze, skip = zlib.compressobj(level, wbits=31), revisit
                put(squeeze.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http).encode()))
            elif not skip:
                put(squeeze.compress(data))
        if out:
            end_record()
            out.close()
            done.append((path, records, size))
        yield from _batches(iter(done), _FILES)

    return run


def _inflated(stream, block: int = CHUNK) -> Iterator[bytes]:
    """What the gzip members of a file hold, in pieces of at most ``block`` bytes."""
    member, data = zlib.decompressobj(wbits=31), b""
    while True:
        data = data or stream.read(block)
        if not data:
            return
        piece = member.decompress(data, block)
        data = member.unconsumed_tail
        if piece:
            yield piece
        if member.eof:
            data, member = member.unused_data, zlib.decompressobj(wbits=31)


class _Feed:
    """Bytes that come in pieces, taken up to a mark or by count."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.held.find(mark)) < 0:
            piece = next(self.pieces, b"")
            if not piece:
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
            self.held += piece
        head, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return head

    def some(self, most: int) -> bytes:
        self.held = self.held or next(self.pieces, b"")
        if not self.held:
            raise ValueError("the archive ends within a record")
        piece, self.held = self.held[:most], self.held[most:]
        return piece

    def exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            out += self.some(n - len(out))
        return out


def _parsed(pieces: Iterator[bytes], with_data: bool) -> Iterator[tuple]:
    feed, page = _Feed(pieces), re.compile(r"<urn:page:(-?\d*):(\d+)>")
    while head := feed.until(b"\r\n\r\n"):
        version, *lines = head.decode().split("\r\n")[:-2]
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        own, uid = page.fullmatch(fields["WARC-Record-ID"]).groups()
        refers = page.fullmatch(fields.get("WARC-Refers-To", ""))
        kind, digest, length = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        left = int(fields["Content-Length"]) - len(feed.until(b"\r\n\r\n"))
        row = (int(uid), int(own) if own else None, fields.get("WARC-Target-URI"), kind, int(refers[1]) if refers and refers[1] else None, length, digest)
        sha1, read, chunk_no = hashlib.sha1(usedforsecurity=False), 0, 0
        while left:
            piece = feed.some(min(left, CHUNK))
            sha1.update(piece)
            left, read = left - len(piece), read + len(piece)
            if with_data:
                yield *row, chunk_no, left == 0, piece
            chunk_no += 1
        if kind == "response" and (read != length or base64.b32encode(sha1.digest()).decode() != digest):
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
        if not with_data or not read:
            yield *row, max(chunk_no - 1, 0), True, None
        if feed.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']}: no end mark")


def _read_archives(root: str, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)

        def rows():
            for path, *_ in _rows(batches):
                with store.open_input_stream(f"{folder}/{path}", compression=None) as stream:
                    yield from _parsed(_inflated(stream), with_data)

        return _batches(rows(), _RECORDS)

    return run


def write_archives(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK, date: str = "1970-01-01T00:00:00Z", level: int = 6, roll: int = ROLL) -> tuple[str, DataFrame]:
    """Write one record a row of ``pages``; returns the archives' folder and the manifest of its files.

    A string payload is taken as UTF-8, a null one as empty. Payloads of fewer than ``min_bytes``
    bytes are never revisits. Null ids sort last when the response of equal payloads is chosen; rows
    that share an id and a payload make one response and revisits of it. Other columns are not read.
    """
    own = columns_as(pages, page_id=id_col, url=url_col, payload=payload_col).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("payload").cast("binary").alias("payload"))
    chunks = work.table(chunk_table(own, chunk_bytes), "chunks")
    lead = chunks.where("last").select("uid", "page_id", "url", "n_bytes").join(roles(chunks, min_bytes), "uid").withColumn("chunk_no", F.lit(-1).cast("long"))
    parts = lead.unionByName(chunks.select("uid", "chunk_no", "data"), allowMissingColumns=True)
    parts = parts.repartition("uid").sortWithinPartitions("uid", "chunk_no").select("uid", "page_id", "url", "n_bytes", "chunk_no", "data", "sha1", "revisit", "refers_to", "refers_uid")
    root = f"{work.root}/archives"
    manifest = work.table(parts.mapInArrow(_write_archives(root, date, level, roll), "path string, records long, n_bytes long"), "manifest")
    work.drop("chunks")
    return root, manifest


def read_archives(root: str, manifest: DataFrame, with_data: bool = False) -> DataFrame:
    """The records of the listed files: a row a chunk with data, or a row a record without.

    Every response's payload is checked against its digest while it streams.
    """
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(_read_archives(root, with_data), RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    work = Workspace(pages.sparkSession, "warc")
    return read_archives(*write_archives(pages, work, **options)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
