"""WARC archives: one gzip member for each record, written and read by tasks as streams.

The archives lie in a folder that all executors reach, named by a URI. A task names its files with a
random part and hands over the names only when it ends, so files of attempts that were lost are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_in_arrow, staged

CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def first_holders(records: DataFrame, key: str, payload: str, at_least: int = 0) -> DataFrame:
    """Adds refers_to: null for responses, for revisits the largest key among the records of the same payload.

    Equal payloads are those of equal SHA-1 and length. Payloads of fewer than at_least bytes are all responses.
    Of repeated rows with the largest key each is a response. Null payloads count as empty.

    A payload may be that of a third of all records, so only digests are grouped, after sums by task. The holders of more than one record are written as a table, whose
    size is then known: where they are few the payloads are not shuffled for them, else the join can split a large key.
    """
    data = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    records = records.withColumns({"__digest": F.sha1(data), "__bytes": F.octet_length(data)})
    holders = records.groupBy("__digest", "__bytes").agg(F.max(key).alias("__holder"), F.count("*").alias("__n")).where("__n > 1").select("__digest", "__bytes", "__holder")
    refers = F.when((F.col("__bytes") >= at_least) & (F.col("__holder") != F.col(key)), F.col("__holder"))
    return records.join(staged(holders, "warc-holders"), ["__digest", "__bytes"], "left").withColumn("refers_to", refers).drop("__digest", "__bytes", "__holder")


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def record(key: object, uri: str, payload: bytes, refers_to: object | None, when: str) -> bytes:
    """A gzip member with a response record, or with a revisit record that holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", when), ("WARC-Target-URI", " ".join(uri.split()))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, block)


def write(records: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", at_least: int = 0, archive_bytes: int = 64 << 20, when: datetime = datetime(2024, 1, 1, tzinfo=UTC)) -> DataFrame:
    """Write a record for each row to archives under folder; the manifest of the archives (MANIFEST) as a DataFrame.

    Take the manifest's rows once (write it as a table): each evaluation writes archives of its own.
    Null payloads and URIs count as empty. An archive is closed after archive_bytes compressed bytes. Repeated rows each give a record; an empty table gives no archive;
    other columns, whatever their names, play no part.
    """
    stamp = when.strftime("%Y-%m-%dT%H:%M:%SZ")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, n, size, closed = None, "", 0, 0, []
        for batch in batches:
            for k, u, p, r in zip(*map(_values, batch.columns), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(path, compression=None), 0, 0
                member = record(k, u or "", (p or "").encode(), r, stamp)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    closed.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            closed.append((path, n, size))
        if closed:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*closed, strict=True)], names=["path", "records", "bytes"])

    chosen = first_holders(records.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.col(payload).cast("string").alias("payload")), "key", "payload", at_least)
    return map_in_arrow(chosen.select("key", "uri", "payload", "refers_to"), archives, MANIFEST)


def _values(column: pa.Array) -> Iterator:
    return (x.as_py() for x in column)


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, one after the other, each as its decompressed pieces."""
    pending = b""

    def pieces(unpacker) -> Iterator[bytes]:
        nonlocal pending
        while not unpacker.eof:
            data = unpacker.unconsumed_tail or pending or stream.read(CHUNK)
            pending = b""
            if not data:
                raise ValueError("the archive ends within a record")
            yield unpacker.decompress(data, CHUNK)
        pending = unpacker.unused_data

    while True:
        pending = pending or stream.read(CHUNK)
        if not pending:
            return
        own = pieces(zlib.decompressobj(31))
        yield own
        for _ in own:  # what a reader has left of the member
            pass


def _head(buffer: bytearray, more: Iterator[bytes]) -> tuple[str, dict[str, str]]:
    """The first line and the headers up to the blank line, which go from the buffer."""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(more, None)
        if piece is None:
            raise ValueError("a record has no end of headers")
        buffer += piece
    first, *lines = buffer[:end].decode().split("\r\n")
    del buffer[: end + 4]
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_record(pieces: Iterator[bytes]) -> Record:
    """One record, framed by its content length; its digests are verified as the pieces come, none is kept."""
    buffer = bytearray()
    version, headers = _head(buffer, pieces)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]}")
    left = int(headers["content-length"])
    block, payload, payload_bytes = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), 0

    def block_pieces() -> Iterator[bytes]:
        nonlocal left
        while left:
            if not buffer:
                piece = next(pieces, None)
                if piece is None:
                    raise ValueError("a record is shorter than its content length")
                buffer.extend(piece)
            part = bytes(buffer[:left])
            del buffer[: len(part)]
            left -= len(part)
            block.update(part)
            if part:
                yield part

    body = block_pieces()
    inner = bytearray()
    _, http = _head(inner, body)
    payload.update(inner)
    payload_bytes = len(inner)
    for part in body:
        payload.update(part)
        payload_bytes += len(part)
    if bytes(buffer) + b"".join(pieces) != b"\r\n\r\n":
        raise ValueError("a record does not end after its content length")
    text = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
    if text(block) != headers["warc-block-digest"]:
        raise ValueError(f"block digest of {headers['warc-record-id']} is wrong")
    if headers["warc-type"] == "response" and text(payload) != headers["warc-payload-digest"]:
        raise ValueError(f"payload digest of {headers['warc-record-id']} is wrong")
    if headers["warc-type"] != "response":
        payload_bytes = int(http["content-length"])
    return Record(headers, payload_bytes, headers["warc-payload-digest"].removeprefix("sha1:"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records (RECORDS) of the archives that manifest names, with lengths and digests verified; a broken one raises.

    payload_bytes and payload_digest are those of the full payload, for revisits too.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(*map(_values, batch.columns), strict=True):
                rows, n = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        r = read_record(member)
                        h, n = r.headers, n + 1
                        rows.append((_id(h["warc-record-id"]), h["warc-type"], h["warc-target-uri"], _id(h.get("warc-refers-to")), r.payload_bytes, r.payload_digest))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records, its manifest says {expected}")
                if rows:
                    yield _rows(rows)

    return map_in_arrow(manifest.select("path", "records"), records, RECORDS)


def _id(urn: str | None) -> str | None:
    return urn and urn.removeprefix("<urn:page:").removesuffix(">")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 4 + [pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest"])
