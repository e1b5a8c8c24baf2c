"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

Pages become WARC records in archives that are one gzip stream each.  The
normaliser inflates such a stream once, from front to back, rewrites every
record as a gzip member of its own and writes a sidecar index with the offset
and length of each member.  The reader then opens members by the index.

Files are written with pyarrow's file systems below the folder that all
machines share, under names of their own for each attempt, and only the names
that a finished task has returned are used; a lost executor's task runs again.

Defined results: a null payload counts as empty.  Of equal payloads of at least
a least number of bytes, the record with the smallest id is a response and the
others are revisits of it.  Null ids are never the smallest unless all are null;
repeated rows with the smallest id are all responses, and so are smaller
payloads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_importable, join_groups, pieces, shared_dir

LEAST_BYTES = 0
#: Bytes that are read or inflated at once, and payload bytes after which a task begins another archive.
CHUNK, ARCHIVE = 1 << 20, 256 << 20
LEVEL = 1
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(ident, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record; a revisit has the full payload's digest and length in its header and no block."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{json.dumps(ident)}>",
        f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), '').replace(chr(10), '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{json.dumps(refers_to)}>"]
    block = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and payload of a record; raises ValueError if it is cut or its payload differs from its digest."""
    head, _, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != END:
        raise ValueError("a record is cut short")
    payload = rest[:n].partition(END)[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise ValueError("a payload differs from its digest")
    return fields, payload


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of a gzip stream of one member or several, inflated once in bounded pieces."""
    z = zlib.decompressobj(31)
    for data in chunks:
        while data:
            piece = z.decompress(data, CHUNK)
            if piece:
                yield piece
            if z.eof:
                data = z.unused_data
                z = zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if tail := z.flush():
        yield tail


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed stream; each is cut by its Content-Length."""
    held = bytearray()
    parts = iter(parts)
    more = True
    while True:
        at = held.find(END)
        if at >= 0:
            low = bytes(held[:at]).lower()
            i = low.rfind(b"\r\ncontent-length:")
            size = at + 4 + int(low[i + 17 :].split(b"\r\n")[0]) + 4
            while len(held) < size and more:
                piece = next(parts, None)
                more = piece is not None
                held += piece or b""
            if len(held) < size:
                raise ValueError("the archive is cut short")
            yield bytes(held[:size])
            del held[:size]
            continue
        piece = next(parts, None) if more else None
        if piece is None:
            if held.strip():
                raise ValueError("the archive is cut short")
            return
        held += piece


def _read(files: fs.FileSystem, path: str) -> Iterator[bytes]:
    with files.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            yield data


def normalise(files: fs.FileSystem, path: str, out: str, index: str) -> int:
    """Rewrite a whole-file gzip stream with a member for each record, and its index; returns the number of records.

    index has a line for each record: offset, length, record id.
    """
    offset = n = 0
    with files.open_output_stream(out, compression=None) as f, files.open_output_stream(index, compression=None) as side:
        for data in records(inflated(_read(files, path))):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            f.write(member)
            ident = data[: data.index(END)].decode().partition("\r\nWARC-Record-ID: ")[2].partition("\r\n")[0]
            side.write(f"{offset}\t{len(member)}\t{ident}\n".encode())
            offset += len(member)
            n += 1
    return n


def read_members(files: fs.FileSystem, path: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of the records of a normalised archive, found by its index."""
    with files.open_input_stream(index, compression=None) as side:
        entries = [tuple(map(int, line.split(b"\t")[:2])) for line in side.read().splitlines()]
    with files.open_input_file(path) as f:
        for offset, length in entries:
            f.seek(offset)
            yield parse(zlib.decompress(f.read(length), 31))


def read_record(files: fs.FileSystem, path: str, index: str, ident) -> tuple[dict[str, str], bytes] | None:
    """Header fields and payload of the record of one page of a normalised archive, by its index alone; None if it isn't there."""
    own = f"<urn:page:{json.dumps(ident)}>"
    with files.open_input_stream(index, compression=None) as side:
        found = next((x for x in (line.split("\t") for line in side.read().decode().splitlines()) if x[2] == own), None)
    if found is None:
        return None
    with files.open_input_file(path) as f:
        f.seek(int(found[0]))
        return parse(zlib.decompress(f.read(int(found[1])), 31))


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    files.create_dir(path, recursive=True)
    return files, path


def roles(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """id, url, payload (binary) and refers_to (null for responses) of each page."""
    at = shared_dir(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    told = rows.withColumn("sum", F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    # each task counts its own payloads first, so that copies of one page are one row of it
    groups = cut(told.groupBy("sum").agg(F.min("id").alias("first"), F.count("*").alias("n")), f"{at}/payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    several = groups.where("n > 1")
    joined = join_groups(told, several, "sum", "n", total)
    refers = F.when((F.octet_length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("id", "url", "payload", refers.alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write roles() rows to whole-file gzip archives in a folder; one row per archive: path, n_records."""
    ensure_importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _folder(folder)
        out, n, size, path = None, 0, 0, ""

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

        for part in (x for batch in batches for x in pieces(batch)):
            for ident, url, payload, refers in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = files.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                out.write(z.compress(record(ident, url, payload, refers, refers is not None)))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records long")


def normalise_all(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives of a table (path); one row each: path, index, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = f"{base}/{uuid.uuid4().hex}.warc.gz"
                n = normalise(files, path, out, out + ".idx")
                yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([out + ".idx"]), pa.array([n], pa.int64())], ["path", "index", "n_records"])

    return archives.select("path").mapInArrow(run, "path string, index string, n_records long")


def read(archives: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """The records of normalised archives (path, index): id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _folder(folder)
        names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        key = pa.int64() if kind == "long" else pa.string()
        types = [key, pa.string(), pa.int64(), pa.string(), pa.string(), key, pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, index in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for h, block in read_members(files, path, index):
                    ident = json.loads(h["warc-record-id"][10:-1])
                    refers = json.loads(h["warc-refers-to"][10:-1]) if "warc-refers-to" in h else None
                    full = int(h["x-payload-length"]) if h["warc-type"] == "revisit" else len(block)
                    rows.append((ident, h["warc-target-uri"], full, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], refers, block))
                    size += len(block)
                    if size > 8 * CHUNK:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return archives.select("path", "index").mapInArrow(run, f"id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archives, normalise these and read them back: key, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    at = shared_dir(spark)
    kind = "long" if pages.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    written = cut(write(roles(pages, key, url, payload, least_bytes), f"{at}/whole"), f"{at}/written")
    n = written.count()
    parts = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    members = cut(normalise_all(written.repartition(parts), f"{at}/members"), f"{at}/normalised")
    found = read(members.repartition(parts), f"{at}/members", kind)
    return found.select(F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
