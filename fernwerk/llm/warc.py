"""WARC writing with revisit resolution, and reading.

Headers are shuffled by payload digest to find each digest's original; payloads are not. What is found, the revisits, goes to the
pages as a broadcast where it is small, and else by a join on page and digest, whose keys are not hot. A revisit has no body.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from fernwerk.storage import materialise, scratch

#: Smaller payloads are always stored; a revisit record would hardly be smaller.
LEAST_BYTES = 1000
#: Uncompressed bytes after which a task begins the next archive.
ARCHIVE_BYTES = 256 << 20
#: Revisits up to this many are broadcast to the writers (about 150 bytes each); more are joined.
BROADCAST_ROWS = 200_000
_CRLF = b"\r\n"


def record(kind: str, page_id: int | None, uri: str, digest: str, date: str, payload: bytes, size: int, refers_to: int | None, refers_uri: str = "") -> bytes:
    """One WARC/1.1 record. A revisit has an empty block and names the original's record id, address, date and payload digest."""
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {record_id(page_id)}".encode(), f"WARC-Date: {date}".encode(), b"WARC-Target-URI: " + uri.encode(), f"WARC-Payload-Digest: sha1:{digest}".encode(), f"X-Page-Id: {'' if page_id is None else page_id}".encode(), f"X-Payload-Length: {size}".encode()]
    block = b""
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}".encode(), b"WARC-Refers-To-Target-URI: " + refers_uri.encode(), f"WARC-Refers-To-Date: {date}".encode(), f"X-Refers-To-Page: {refers_to}".encode()]
    else:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        head.append(b"Content-Type: application/http; msgtype=response")
        block = http + payload
    head += [f"WARC-Block-Digest: sha1:{sha1(block).hexdigest()}".encode(), f"Content-Length: {len(block)}".encode()]
    return _CRLF.join(head) + _CRLF + _CRLF + block + _CRLF + _CRLF


def info(name: str, date: str) -> bytes:
    """The record that begins an archive."""
    block = b"software: fernwerk\r\nformat: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>".encode(), f"WARC-Date: {date}".encode(), f"WARC-Filename: {name}".encode(), b"Content-Type: application/warc-fields", f"WARC-Block-Digest: sha1:{sha1(block).hexdigest()}".encode(), f"Content-Length: {len(block)}".encode()]
    return _CRLF.join(head) + _CRLF + _CRLF + block + _CRLF + _CRLF


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _clean_uri(uri: str | None) -> str:
    return "".join(c for c in uri or "" if c not in "\r\n")


def _writer(folder: str, date: str, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, rows, size = None, "", 0, 0
        made: list[tuple[str, int]] = []
        for b in batches:
            for page, url, html, digest, size_, kind, refers, address in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "record_type", "refers_to", "refers_url"))):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"  # of an attempt that fails or is repeated, nothing reads the file
                    raw = fs.open_output_stream(name, compression=None)
                    out, rows, size = raw, 0, 0
                    out.write(gzip.compress(info(os.path.basename(name), date), 1, mtime=0))
                text = record(kind, page, _clean_uri(url), digest, date, (html or "").encode(), size_, refers, _clean_uri(address))
                out.write(gzip.compress(text, 1, mtime=0))  # a member for each record, as readers that seek need it
                rows, size = rows + 1, size + len(text)
                if size >= most:
                    out.close()
                    made.append((os.path.basename(name), rows))
                    out = None
        if out is not None:
            out.close()
            made.append((os.path.basename(name), rows))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made]), pa.array([x for _, x in made], pa.int64())], ["file", "records"])

    return run


def parse(stream: object) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line == _CRLF:
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (_CRLF, b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


def _reader(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for file in b.column("file").to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.open(raw) as stream:
                    for head, block in parse(stream):
                        if sha1(block).hexdigest() != head["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"a block of {file} does not match its digest")
                        if head["warc-type"] == "warcinfo":
                            continue
                        payload = None
                        kind, digest, n = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if kind == "response":
                            payload = block.partition(_CRLF + _CRLF)[2]
                            if sha1(payload).hexdigest() != digest or len(payload) != n:
                                raise ValueError(f"payload of page {head['x-page-id']} does not match its digest")
                        page, refers = head["x-page-id"], head.get("x-refers-to-page")
                        rows.append((int(page) if page else None, head["warc-target-uri"], kind, digest, n, int(refers) if refers else None, payload))
                        size += len(payload or b"")
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def resolve_revisits(pages: DataFrame, least: int = LEAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, html, digest, size, record_type, refers_to, refers_url): of pages with equal payloads of ``least`` bytes or more,
    the one with the largest page_id is the response and the others revisit it, without html.

    Originals are found by an aggregate of headers with map-side combine, so a payload of very many pages is one row a task, and the
    join that names the revisits carries no payloads. Null html is an empty payload. Rows repeated with one
    page_id and payload are each a response if that page is the original. A null page_id is the least one.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    heads = materialise(rows.where(F.col("size") >= least).select(F.coalesce("page_id", F.lit(-(2**63))).alias("page"), "url", "digest"), "heads")
    originals = heads.groupBy("digest").agg(F.max(F.struct("page", "url")).alias("o"), F.count(F.lit(1)).alias("times")).where("times >= 2").select("digest", F.col("o.page").alias("original"), F.col("o.url").alias("refers_url"))
    revisits = materialise(heads.join(originals, "digest").where("page <> original").select("digest", "page", "original", "refers_url").distinct(), "revisits")
    small = revisits.limit(broadcast_rows + 1).count() <= broadcast_rows
    same = (rows["digest"] == revisits["digest"]) & (F.coalesce(rows["page_id"], F.lit(-(2**63))) == revisits["page"]) & (rows["size"] >= least)
    again = F.col("original").isNotNull()
    found = rows.join(F.broadcast(revisits) if small else revisits, same, "left")
    return found.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), rows["digest"], "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("original").alias("refers_to"), "refers_url")


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes deduplicated archives; returns the folder and the manifest (file, records) of the committed ones.

    A task that is run twice writes files of other names; only those of the attempt that counts are in the manifest.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = resolve_revisits(pages, least)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return folder, materialise(rows.mapInArrow(_writer(folder, date, archive_bytes), "file string, records long"), "warc-manifest")


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of every record; digests are verified."""
    files = manifest.select("file").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    return files.mapInArrow(_reader(folder), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
