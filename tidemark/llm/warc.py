"""WARC archives: a writer and a splittable reader.

The writer makes one gzip member per record, one or more files per task, in the
shared folder. Equal payloads are stored once: the row with the largest id is
the response, the others are revisit records that refer to it.

The reader cuts the files into byte ranges. A task scans its range for the gzip
magic, accepts a candidate when it decodes to a WARC header, and owns the records
that start inside its range, however far they reach. No index is needed, and
memory holds one range and one record.

Files are reached through ``pyarrow.fs``, so the shared folder may be any store
it knows (a mounted path, HDFS, object stores). A task attempt writes under a
name of its own and only files in the returned manifest count, so a lost
executor or a repeated task leaves no wrong archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_path, spread_join, stage, text_or_empty

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
TASK_BYTES = 256 << 20  # of archives that one task reads
FILE_BYTES = 1 << 30
LEVEL = 3  # of gzip: half the time of the usual 6 for some percent more bytes
_STEP = 1 << 20
_URN = "urn:page:"
_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and ":/" in path:  # file:/x
        path = path.replace(":/", ":///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(value: object) -> str:
    return "" if value is None else str(value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member with a response or revisit record (the HTTP head of a revisit keeps the payload's length)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    body = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(body) + squeeze.flush()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` plus ``revisit`` and ``refers_to``.

    Among rows with equal payloads of at least ``min_bytes`` bytes those with the
    largest id are responses, the others revisit it; shorter ones are responses.
    A NULL html is an empty payload. Rows with a NULL id revisit the largest id if
    there is one. A payload that a large share of the rows have is dealt over many
    tasks (``spread_join``).
    """
    src = pages.select("page_id", "url", text_or_empty("html").cast("binary").alias("payload"))
    src = src.withColumn("_lm_sha", F.unhex(F.sha1("payload")))
    groups = stage(src.groupBy("_lm_sha").agg(F.max("page_id").alias("_lm_first"), F.count(F.lit(1)).alias("_lm_rows")), "payloads")
    total = groups.agg(F.sum("_lm_rows")).first()[0] or 0
    joined = spread_join(src, groups, "_lm_sha", "_lm_rows", total, F.xxhash64("page_id", F.monotonically_increasing_id()))
    again = (F.octet_length("payload") >= min_bytes) & F.col("_lm_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_lm_first"))
    return joined.select("page_id", "url", "payload", again.alias("revisit"), F.when(again, F.col("_lm_first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` below ``path``; the manifest (path, bytes, records)
    is itself a table there and is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        out, name, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, payload, revisit, refers_to = (x.as_py() for x in row)
                data = record_bytes(page_id, url, payload, refers_to, revisit, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    manifest = records.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, "path string, bytes long, records long")
    return stage(manifest, "manifest")

_BEGIN = b"WARC/"


class _Window:
    """Bytes of a file from ``start`` on, fetched as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int, size: int):
        self.file, self.start, self.size = file, start, size
        self.data = bytearray()

    def grow(self, n: int = _STEP) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(n, self.size - at), at)
        return True


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The WARC record in the gzip member at ``at`` and the member's end; None if there is none. A member whose
    content begins like a record but is cut off or damaged is an error, never left out."""
    # the first bytes alone: damage further on must not hide that a record begins here
    probe, head, pos = zlib.decompressobj(31), b"", at
    while len(head) < len(_BEGIN) and not probe.eof:
        if pos >= len(window.data) and not window.grow():
            return None
        piece = bytes(window.data[pos : pos + 512])
        try:
            head += probe.decompress(piece, len(_BEGIN) - len(head))
        except zlib.error:
            return None
        pos += len(piece)
    if head != _BEGIN:
        return None
    inflate, out, pos, step = zlib.decompressobj(31), [], at, 1 << 13
    while not inflate.eof:
        if pos >= len(window.data) and not window.grow():
            raise ValueError(f"record at byte {window.start + at} is cut off")
        piece = bytes(window.data[pos : pos + step])
        step = min(2 * step, _STEP)
        try:
            out.append(inflate.decompress(piece))
        except zlib.error as damage:
            raise ValueError(f"record at byte {window.start + at} is damaged") from damage
        pos += len(piece)
    whole = b"".join(out)
    if b"\r\n\r\n" not in whole:
        return None
    return whole, pos - len(inflate.unused_data)


def scan(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that start in [start, end)."""
    window = _Window(file, start, size)
    window.grow(end - start)
    limit, at = end - start, 0
    while True:
        at = window.data.find(MAGIC, at)
        while at < 0 or at + len(MAGIC) > len(window.data):
            tail = max(0, len(window.data) - len(MAGIC) + 1)
            if tail >= limit or not window.grow(len(MAGIC)):
                return
            at = window.data.find(MAGIC, tail)
        if at >= limit:
            return
        found = _member(window, at)
        if found is None:
            at += 1
        else:
            yield start + at, found[0]
            at = found[1]


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the payload."""

    def headers(data: bytes) -> dict[str, str]:
        lines = data.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = record.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def read_archives(spark: SparkSession, path: str, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, keep_payload: bool = True) -> DataFrame:
    """The records of the manifest's files: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (checked against the payload of responses) and, on wish, the payload."""
    splits = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    seen = splits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.least("bytes", F.lit(split_bytes))), F.lit(0)).alias("bytes")).first()
    # a task reads several splits once there are more than the cores are worth
    tasks = min(seen["n"], max(2 * spark.sparkContext.defaultParallelism, seen["bytes"] // TASK_BYTES))
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"

    def number(value: str | None) -> int | None:
        text = (value or "").strip("<>").removeprefix(_URN)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_payload
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * keep_payload
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with store.open_input_file(f"{root}/{name}") as file:
                    if file.size() != size:
                        raise ValueError(f"{name} has {file.size()} bytes, its manifest says {size}")
                    for _, record in scan(file, size, start, min(start + split_bytes, size)):
                        warc, http, payload = parse(record)
                        kind, mark = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                        length = int(http["content-length"])
                        if kind == "response" and (mark != digest(payload) or length != len(payload)):
                            raise ValueError(f"damaged record {warc['warc-record-id']} in {name}")
                        url = warc.get("warc-target-uri")
                        rows.append((number(warc["warc-record-id"]), None if url is None else unquote(url), kind,
                                     number(warc.get("warc-refers-to")), length, mark) + ((payload,) if keep_payload else ()))
                        held += len(payload) if keep_payload else 100
                        if held > _STEP * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return splits.select("path", "bytes", "start").repartition(max(1, tasks)).mapInArrow(run, schema + (", payload binary" if keep_payload else ""))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES, keep_payload: bool = True) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    manifest = write_archives(with_revisits(pages, min_bytes), path)
    return read_archives(spark, path, manifest, split_bytes, keep_payload)
