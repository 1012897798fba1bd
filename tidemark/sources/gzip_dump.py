"""Splittable reader of gzip dumps (S1-S3) as a Python data source.

A gzip file may hold many members (block-compressed or concatenated dumps do). The reader plans
byte ranges; a task finds the members that start in its range by their magic number, checks a
candidate by decoding its head, and reads the lines that begin in them. As with
plain text splits, a task other than the first leaves out what precedes its first line end, and every
task reads on to the first line end behind its range, so lines that cross members or ranges
are read once, whole. A file of one member is one task's work, streamed.

Rows are text (``\\N`` and empty fields are NULL, quoting is off). A line with another number of fields
than the header is not padded or cut: it comes back whole in the column ``_malformed``, all other
columns NULL. Every file begins with the same header line.

Files are opened with ``pyarrow.fs`` on the driver (sizes and header) and in the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MALFORMED = "_malformed"
NULLS = ["\\N", ""]
MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 128 << 20
_STEP = 1 << 20
_BLOCK = 8 << 20  # text parsed at once
_PROOF = 1 << 18  # decoded bytes that prove a member; chance magic fails far earlier


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, name


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of ``path`` itself or of the ``.gz`` files below it, in name order."""
    store, name = _open(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    below = store.get_file_info(fs.FileSelector(name, recursive=True))
    prefix = path.removesuffix(name)
    return sorted((prefix + f.path, f.size) for f in below if f.type == fs.FileType.File and f.path.endswith(".gz"))


def _member(file: pa.NativeFile, size: int, at: int) -> Iterator[bytes | int]:
    """Decoded pieces of the member at ``at``, then (an int) where it ends; zlib.error if there is none."""
    inflate, pos = zlib.decompressobj(31), at
    while not inflate.eof:
        if pos >= size:
            raise EOFError(f"gzip member at byte {at} is cut off")
        piece = file.read_at(min(_STEP, size - pos), pos)
        pos += len(piece)
        yield inflate.decompress(piece)
    yield pos - len(inflate.unused_data)


def _is_member(file: pa.NativeFile, size: int, at: int) -> bool:
    inflate, pos, seen = zlib.decompressobj(31), at, 0
    try:
        while not inflate.eof and seen < _PROOF and pos < size:
            piece = file.read_at(min(1 << 16, size - pos), pos)
            pos += len(piece)
            seen += len(inflate.decompress(piece, _PROOF))
        return True
    except zlib.error:
        return False


def _first_member(file: pa.NativeFile, size: int, start: int, end: int) -> int | None:
    """The first member that starts in [start, end)."""
    at = start
    while at < end:
        window = file.read_at(min(_STEP, end - at) + len(MAGIC) - 1, at)
        found = window.find(MAGIC)
        while found >= 0 and at + found < end:
            if _is_member(file, size, at + found):
                return at + found
            found = window.find(MAGIC, found + 1)
        at += _STEP
    return None


def lines(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """Blocks of whole lines: those that begin in the members starting in [start, end)."""
    at = _first_member(file, size, start, end)
    if at is None:
        return
    skip, held = at > 0, bytearray()
    while at < size:
        owned = at < end
        if not owned and skip:
            return  # no line begins in the members of this range
        for piece in _member(file, size, at):
            if isinstance(piece, int):
                at = piece
                break
            if skip:
                cut = piece.find(b"\n") + 1
                if not cut:
                    continue
                piece, skip = piece[cut:], False
            if not owned and (cut := piece.find(b"\n") + 1):
                yield bytes(held + piece[:cut])
                return
            held += piece
            if owned and len(held) >= _BLOCK and (cut := held.rfind(b"\n") + 1):
                yield bytes(held[:cut])
                del held[:cut]
        while at < size and file.read_at(min(_STEP, size - at), at).strip(b"\0") == b"":
            at += min(_STEP, size - at)  # padding behind the last member
    if held:
        yield bytes(held)


def _header(path: str) -> list[str]:
    for name, size in _files(path):
        store, inner = _open(name)
        with store.open_input_file(inner) as file:
            text = b""
            for piece in _member(file, size, 0):
                if isinstance(piece, int) or b"\n" in text:
                    break
                text += piece
            return text.split(b"\n", 1)[0].rstrip(b"\r").decode().split("\t")
    raise FileNotFoundError(f"no .gz file below {path}")


def parse(block: bytes, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The lines of ``block`` as text columns, malformed ones whole in the last column."""
    bad: list[str] = []

    def reject(row: pacsv.InvalidRow) -> str:
        bad.append(row.text)
        return "skip"

    try:
        block.decode()
    except UnicodeDecodeError:
        block = block.decode("utf-8", "replace").encode()
    empty = pa.table({n: pa.array([], pa.string()) for n in names})
    table = empty if not block.strip(b"\r\n") else pacsv.read_csv(
        pa.py_buffer(block),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(block) + 1),
        parse_options=pacsv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False, invalid_row_handler=reject),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=NULLS, strings_can_be_null=True),
    )
    table = table.append_column(MALFORMED, pa.nulls(len(table), pa.string()))
    yield from table.to_batches()
    if bad:
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(bad), pa.string()) for _ in names], pa.array(bad)], [*names, MALFORMED])


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], options: dict):
        self.names, self.path = names, options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[_Range]:
        return [_Range(p, size, s, min(s + self.split_bytes, size)) for p, size in _files(self.path) for s in range(0, size, self.split_bytes)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, inner = _open(part.path)
        with store.open_input_file(inner) as file:
            for i, block in enumerate(lines(file, part.size, part.start, part.end)):
                if i == 0 and part.start == 0:
                    head, _, block = block.partition(b"\n")
                    if head.rstrip(b"\r").decode().split("\t") != self.names:
                        raise ValueError(f"header of {part.path} differs from {self.names}")
                yield from parse(block, self.names)


class GzipDump(DataSource):
    """``spark.read.format("gzip_dump").option("splitBytes", n).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "gzip_dump"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in [*_header(self.options["path"]), MALFORMED]])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader([n for n in schema.fieldNames() if n != MALFORMED], dict(self.options))


def read_gzip_dump(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All lines below ``path``: the header's columns as text and ``_malformed``."""
    spark.dataSource.register(GzipDump)
    return spark.read.format(GzipDump.name()).option("splitBytes", split_bytes).load(path)
