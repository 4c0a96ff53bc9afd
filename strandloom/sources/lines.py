"""Lines of text files as rows (path, start, value), in order within a split: plain files by Spark's own splits, BGZF files by theirs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, start long, value binary"
SPLIT_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
#: A block of BGZF has at most so many bytes.
_BLOCK = 1 << 16
_ROWS = 5_000


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of plain or gzipped files without their ends. A plain file is read in splits, a gzipped one as one stream; neither is held whole."""
    rows = spark.read.text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def is_bgzf(path: str) -> bool:
    """Whether the file begins with a block of BGZF; False where it can't be opened from here (Spark reads it as a plain gzip stream then)."""
    try:
        fs, name = _opened(path)
        with fs.open_input_file(name) as f:
            return _size(f.read(18)) is not None
    except (OSError, pa.ArrowException):
        return False


def bgzf_lines(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of files of gzip blocks of known size, whose splits are read apart from each other. The files have to be in a store that pyarrow opens."""
    import json

    spark.dataSource.register(Bgzf)
    return spark.read.format("strandloom_bgzf").option("paths", json.dumps(paths)).option("split_bytes", str(split_bytes)).load()


def _opened(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    parts = urlparse(path)
    return (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _size(head: bytes) -> int | None:
    """The size of the block that begins with head, or None if none does."""
    if head[:4] != _MAGIC or len(head) < 18:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        length = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and length == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + length
    return None


def _first_block(f, at: int, size: int) -> int:
    """Where the first block begins from at on: bytes that look like one and are followed by another or by the file's end."""
    if at == 0:
        return 0
    f.seek(at)
    window = f.read(2 * _BLOCK + 18)
    found = window.find(_MAGIC)
    while found >= 0:
        length = _size(window[found : found + 512])
        if length is not None and (at + found + length == size or _size(window[found + length : found + length + 512]) is not None):
            return at + found
        found = window.find(_MAGIC, found + 1)
    return size


def _texts(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Where each block from at on begins, and its text."""
    while at < size:
        f.seek(at)
        block = f.read(_BLOCK)
        length = _size(block)
        if length is None:
            raise ValueError(f"no BGZF block at byte {at}")
        extra = int.from_bytes(block[10:12], "little")
        yield at, zlib.decompress(block[12 + extra : length - 8], -15)
        at += length


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int


class Bgzf(DataSource):
    """Source of bgzf_lines."""

    @classmethod
    def name(cls) -> str:
        return "strandloom_bgzf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BgzfReader:
        import json

        return BgzfReader(json.loads(self.options["paths"]), int(self.options["split_bytes"]))


class BgzfReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> list[Span]:
        spans = []
        for path in self.paths:
            fs, name = _opened(path)
            size = fs.get_file_info(name).size
            spans += [Span(path, at, min(at + self.split_bytes, size)) for at in range(0, size, self.split_bytes)]
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the split's blocks after its first line, and the one that begins where they end; the first split has its first line too."""
        fs, name = _opened(span.path)
        with fs.open_input_file(name) as f:
            size = f.size()
            begin = _first_block(f, span.begin, size)
            if begin >= span.end:
                return
            rest, lines, skipped = b"", [], span.begin == 0
            for at, text in _texts(f, begin, size):
                beyond = at >= span.end
                if beyond and not skipped:
                    return
                rest += text
                *whole, rest = rest.split(b"\n")
                if whole and not skipped:
                    whole, skipped = whole[1:], True
                if beyond:
                    if whole:
                        lines.append(whole[0])
                        rest = b""
                        break
                    continue
                if not skipped:
                    rest = b""
                lines += whole
                if len(lines) >= _ROWS:
                    yield self._batch(span, lines)
                    lines = []
            if rest and skipped:
                lines.append(rest)
            if lines:
                yield self._batch(span, lines)

    @staticmethod
    def _batch(span: Span, lines: list[bytes]) -> pa.RecordBatch:
        ends = [x[:-1] if x.endswith(b"\r") else x for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([span.path] * len(ends)), pa.array([span.begin] * len(ends), pa.int64()), pa.array(ends, pa.binary())], ["path", "start", "value"])
