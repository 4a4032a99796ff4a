"""WARC archives: one gzip member per record, written and read back in sequence.

Writing: payload digests are made on the JVM; the least id of each repeated digest comes from an aggregate that combines
before its shuffle, and only revisits (id, digest, target) are joined to the pages. Each task writes its own archives in the
shared folder, cut at ARCHIVE_BYTES, under names that hold the attempt, and returns their manifest; files of lost attempts
are in no manifest and are never read. Reading: each archive is one stream, inflated a block at a time, member by member;
records are framed by their content length and their digests verified, so memory holds one record and one output batch.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir

ARCHIVE_BYTES = 64 << 20
LEAST_REVISIT = 100
_BLOCK = 1 << 16
_NAMES = uuid.UUID("8a4c1f0e-2f55-4c1a-9a63-0d7e4b7b6c11")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """A broken member, frame or digest."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", *([f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else [])] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(6, wbits=31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated content of each gzip member, a block of input at a time."""
    inflate, held, content = None, b"", []
    while True:
        data = held or stream.read(_BLOCK)
        held = b""
        if not data:
            if inflate is not None:
                raise WarcError("the archive ends within a member")
            return
        if inflate is None:
            inflate = zlib.decompressobj(wbits=31)
        try:
            content.append(inflate.decompress(data))
        except zlib.error as e:
            raise WarcError(f"a broken member: {e}") from e
        if inflate.eof:
            held = inflate.unused_data
            yield b"".join(content)
            inflate, content = None, []


def decode_record(content: bytes, verify: bool = True) -> dict:
    """Headers and block of a record; payload is None for a revisit."""
    end = content.find(b"\r\n\r\n")
    lines = content[: max(end, 0)].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise WarcError("a record without a WARC head")
    head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(head.get("content-length", -1))
    block = content[end + 4 : end + 4 + size]
    if size < 0 or len(block) != size or content[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError("the content length doesn't frame the record")
    kind, split = head.get("warc-type"), block.find(b"\r\n\r\n")
    payload = block[split + 4 :] if kind == "response" else None
    if verify:
        if head.get("warc-block-digest") != "sha256:" + hashlib.sha256(block).hexdigest():
            raise WarcError("the block digest doesn't hold")
        if payload is not None and head.get("warc-payload-digest") != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise WarcError("the payload digest doesn't hold")
    return {"head": head, "type": kind, "payload": payload}


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """For each row whose payload, of LEAST_REVISIT bytes or more, another row with a smaller id has too: id, digest and the
    least id, once for each id and digest. Rows with the least id are no revisits, however often they are there."""
    html = F.coalesce(pages[html_col], F.lit(""))
    slim = saved(pages.select(pages[id_col].cast("long").alias("id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= LEAST_REVISIT).drop("n"))
    firsts = saved(slim.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return slim.join(firsts, slim["digest"] == firsts["of"]).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of pages into archives below folder, a URI that driver and executors share; returns the
    manifest (file, records, bytes) as a written table. Null html is the empty payload; a null url has no target URI."""
    again = saved(revisits(pages, id_col, html_col))
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    joined = rows.join(again, rows["page_id"].eqNullSafe(again["id"]) & (rows["sha"] == again["digest"]), "left").select("page_id", "url", "html", "sha", "refers_to", F.col("digest").isNotNull().alias("again"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, out, made, size, count = TaskContext.get(), None, [], 0, 0
        for batch in batches:
            for page_id, url, text, sha, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, size, count = store.open_output_stream(f"{base}/{name}"), 0, 0
                record = encode_record(page_id, url, text.encode("utf-8"), sha, refers_to, revisit)
                out.write(record)
                size, count = size + len(record), count + 1
                if size >= archive_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", count, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    return saved(joined.mapInArrow(write, "file string, records long, bytes long"))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the files of the manifest, in sequence within a file; with_payload adds payload binary (null for
    a revisit). A broken archive raises WarcError."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
        weight = 0

        def give() -> pa.RecordBatch:
            n = 6 + with_payload
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[:n]], names=list(names[:n]))

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path) as stream:
                    for content in _members(stream):
                        got = decode_record(content)
                        head, payload = got["head"], got["payload"]
                        page, target = head.get("x-page-id"), head.get("x-refers-to-page")
                        length = len(payload) if payload is not None else int(head["x-payload-length"])
                        values = (page and int(page), length, head["warc-payload-digest"].removeprefix("sha256:"), got["type"], target and int(target), head.get("warc-target-uri"), payload)
                        for to, value in zip(cols, values, strict=True):
                            to.append(value)
                        weight += 200 + (length if with_payload else 0)
                        if weight >= 8 << 20:
                            yield give()
                            cols, weight = [[] for _ in cols], 0
        if cols[0]:
            yield give()

    files = manifest.select("file")
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: one row per row of pages, RECORDS. Null html is the
    empty payload, of 0 bytes; a null url has no target; a null id is never referred to, but may itself revisit. Of rows with
    equal payloads and the least id all are responses, however often they are there. Payloads of any length are held one at a
    time. An empty table gives an empty result; columns of pages other than the three aren't read."""
    folder = f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col))
