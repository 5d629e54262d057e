"""WARC archives: a writer and a sequential reader.

Each record is one gzip member. The reader inflates a stream in small pieces with incremental
zlib, starts a new inflater after the end of every member, frames the record by its
Content-Length and compares the payload with its digest. Memory is bounded by one record.

Archives are files in the shared folder. Writer tasks take fresh names and report what they
wrote in a manifest; only the manifest of tasks that were committed is read, so a task that is
run again after the loss of an executor leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.runtime import new_path, written

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """A stream that breaks the format, with the offset of the member."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str, mode: str):
    """A binary stream of any file system that pyarrow knows; plain paths are local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        at, name = fs.LocalFileSystem(), path
    elif path.startswith("file:"):
        at, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        at, name = fs.FileSystem.from_uri(path)
    if mode == "w":
        at.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return at.open_output_stream(name, compression=None)
    return at.open_input_stream(name, compression=None)


def record_id(page_id: object, digest: str) -> str:
    """Id of the response of a page with a payload of this digest. Pages with one id and different payloads have
    records of their own; only rows that are repeated whole share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _value(x: object) -> bytes:
    """A header value as it is; only line breaks, which would end it, are percent-encoded, and stay so when read."""
    return str(x).replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def write_record(out: BinaryIO, headers: list[tuple[str, object]], block: bytes, level: int = 6) -> int:
    """Append one gzip member; returns its length."""
    head = b"".join(k.encode() + b": " + _value(v) + b"\r\n" for k, v in headers)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = z.compress(VERSION + b"\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block))
    data += z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
    out.write(data)
    return len(data)


def _members(stream: BinaryIO) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, pieces) of each gzip member; the pieces of one must be used up before the next."""
    left, offset = b"", 0
    while True:
        if not left:
            left = stream.read(PIECE)
            if not left:
                return
        start = offset

        def pieces() -> Iterator[bytes]:
            nonlocal left, offset
            z = zlib.decompressobj(31)
            while not z.eof:
                if not left:
                    left = stream.read(PIECE)
                    if not left:
                        raise WarcError(f"member at {start} is cut off")
                try:
                    got = z.decompress(left, PIECE * 4)
                except zlib.error as e:
                    raise WarcError(f"member at {start}: {e}") from e
                rest = z.unused_data if z.eof else z.unconsumed_tail
                offset += len(left) - len(rest)
                left = rest
                if got:
                    yield got

        yield start, pieces()


def _parse_head(head: bytes, start: int) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise WarcError(f"member at {start}: no version line")
    out = {}
    for line in lines[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise WarcError(f"member at {start}: header {line[:40]!r}")
        out[k.strip().lower().decode("ascii", "replace")] = v.strip().decode("utf-8", "replace")
    return out


def read_records(stream: BinaryIO, verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a stream, in order."""
    for start, pieces in _members(stream):
        buf = bytearray()
        head = None
        need = 0
        for piece in pieces:
            buf += piece
            if head is None:
                at = buf.find(b"\r\n\r\n")
                if at < 0:
                    continue
                head = _parse_head(bytes(buf[:at]), start)
                if not head.get("content-length", "").isdigit():
                    raise WarcError(f"member at {start}: no content length")
                need = int(head["content-length"])
                del buf[: at + 4]
        if head is None:
            raise WarcError(f"member at {start}: no end of headers")
        if len(buf) != need + 4 or buf[need:] != b"\r\n\r\n":
            raise WarcError(f"member at {start}: {len(buf) - 4} bytes, content length {need}")
        block = bytes(buf[:need])
        if verify and "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{payload_digest(block)}":
            raise WarcError(f"member at {start}: block digest differs")
        yield head, block


def plan_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows that revisit another, one row per id and payload.

    Rows with equal payloads of at least ``least_bytes`` bytes refer to the row with the
    smallest id among them. Null payloads are empty payloads. A row with a null id never is the
    one that others refer to, and refers to it like any other row.
    """
    text = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("n"))
    rows = rows.where(F.col("n") >= least_bytes).groupBy("page_id", "sha").agg(F.count("*").alias("c"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.sum("c").alias("c")).where("c > 1 and refers_to is not null")
    return rows.select("page_id", "sha").join(first.select("sha", "refers_to"), "sha").where("page_id is null or page_id <> refers_to").select("page_id", "sha", "refers_to")


def _http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def _record(page_id, url, payload: bytes, refers_to) -> tuple[list[tuple[str, object]], bytes]:
    head = _http_head(len(payload))
    revisit = refers_to is not None
    block = head if revisit else head + payload
    digest = payload_digest(payload)
    h: list[tuple[str, object]] = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE)]
    h.append(("WARC-Record-ID", record_id(page_id, digest) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"))
    h.append(("WARC-Target-URI", url if url is not None else f"page:{page_id}"))
    h.append(("Content-Type", "application/http; msgtype=response"))
    h.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    h.append(("WARC-Block-Digest", f"sha1:{payload_digest(block)}"))
    if page_id is not None:
        h.append(("X-Page-ID", page_id))
    if revisit:
        h += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    return h, block


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, roll_bytes: int = 16 << 20) -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest ``(path, records, bytes)``.

    Equal payloads are kept once (``plan_revisits``); of several rows with the id that others
    refer to, all are responses. Null payloads are empty. A null url becomes ``page:<id>``. Further columns,
    also ones named like those of the result, are ignored.
    An archive is closed once it has ``roll_bytes``.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        (F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("url"),
        data.alias("payload"),
    )
    plan = plan_revisits(pages, page_id, payload, least_bytes).select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "refers_to")
    decided = rows.withColumn("__own", F.sha2("payload", 256)).join(
        plan, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left"
    ).select("page_id", "url", "payload", "refers_to")

    def write(batches):
        out, path, n, size = None, "", 0, 0
        done = []
        try:
            for b in batches:
                for i, u, p, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    if out is None:
                        path, n, size = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = _open(path, "w")
                        size += write_record(out, [("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size += write_record(out, *_record(i, u, p, r))
                    n += 1
                    if size >= roll_bytes:
                        out.close()
                        done.append((path, n, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((path, n, size))
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(decided.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload_of(head: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(length of the full payload, payload or None for a revisit) of a response or revisit."""
    if not head.get("content-type", "").startswith("application/http"):
        return len(block), block
    http, _, body = block.partition(b"\r\n\r\n")
    if head.get("warc-type") != "revisit":
        return len(body), body
    for line in http.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"content-length":
            return int(v), None
    raise WarcError("a revisit without the length of its payload")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of every response and revisit in the archives listed in ``manifest(path, ...)``.

    Digests of blocks and payloads are verified; a difference raises ``WarcError``. Records of
    other types are passed over.
    """
    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                held = 0
                with _open(path, "r") as stream:
                    for head, block in read_records(stream):
                        if head.get("warc-type") not in ("response", "revisit"):
                            continue
                        size, payload = payload_of(head, block)
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        if payload is not None and payload_digest(payload) != digest:
                            raise WarcError(f"{path}: payload digest of {head.get('warc-record-id')} differs")
                        ref = head.get("x-refers-to-page-id")
                        own = head.get("x-page-id")
                        rows.append((int(own) if own else None, head.get("warc-target-uri"), size, digest, head["warc-type"], int(ref) if ref else None, payload if with_payload else None))
                        held += len(block) if with_payload else 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    paths = manifest.select("path").repartition(n, "path")
    return paths.mapInArrow(read, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to a fresh shared folder and read them back."""
    folder = new_path(spark, "warc")
    return read_archives(write_archives(pages, folder, least_bytes=least_bytes), with_payload=False)
