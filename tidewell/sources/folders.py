"""Folders of many small files as Python data sources: ``tidewell_text`` (a row per file) and ``tidewell_csv`` (a row
per cell).

``register(spark)`` once, then ``spark.read.format("tidewell_text").option("slices", 64).load(folder)``. The driver plans
slices of the names' hashes and lists nothing: each task streams the listing, opens the files of its slice one
after another and hands on bounded batches. So neither names nor contents grow on the driver, and a task that is
lost is read again by itself. The folder must be one that Python opens on every executor: a local or mounted path, or
a store that pyarrow knows (s3, gs, hdfs); ``files.read_text_files`` reads any store that Spark does.
"""

from __future__ import annotations

import csv
import io
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources.files import decoded, sniff

#: Rows and bytes after which a batch is handed on.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
TEXT = "path string, size_bytes long, text string, encoding string, status string, error string"
CELLS = "path string, row_no int, col_no int, value string, status string, warning string"


def _children(folder: str, store) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of what stands in a folder, in any order, without the names of hidden files."""
    if store is None:
        with os.scandir(folder) as entries:
            for entry in entries:
                if not entry.name.startswith(("_", ".")):
                    yield entry.path, entry.is_dir()
        return
    for info in store.get_file_info(pa.fs.FileSelector(folder)):
        if not info.base_name.startswith(("_", ".")):
            yield info.path, info.type == pa.fs.FileType.Directory


def _matches(path: str, store) -> Iterator[tuple[str, bool]]:
    """What a path names; a part of it may hold ``*`` and ``?``. A single file names itself."""
    folder, _, pattern = path.rstrip("/").rpartition("/")
    if not any(c in path for c in "*?"):
        is_folder = os.path.isdir(path) if store is None else store.get_file_info(path).type == pa.fs.FileType.Directory
        yield path.rstrip("/"), is_folder
        return
    for parent, is_folder in _matches(folder, store):
        if is_folder and any(c in pattern for c in "*?"):
            yield from (c for c in _children(parent, store) if fnmatchcase(c[0].rpartition("/")[2], pattern))
        elif is_folder:
            yield from _matches(f"{parent}/{pattern}", store)


def _files(path: str, store) -> Iterator[str]:
    """Files of a folder and of its ``name=value`` folders."""
    waiting = _matches(path, store)
    for found, is_folder in waiting:
        if not is_folder:
            yield found
            continue
        for child, deeper in _children(found, store):
            if not deeper:
                yield child
            elif "=" in child.rpartition("/")[2]:
                yield from _files(child, store)


@dataclass
class Slice(InputPartition):
    """Files whose name's crc32 leaves ``number`` at division by ``of``."""

    number: int
    of: int


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("load(path) must name a folder or file")
        self.path, self.slices = options["path"], max(int(options.get("slices", 16)), 1)

    def partitions(self) -> list[Slice]:
        return [Slice(i, self.slices) for i in range(self.slices)]

    def _opened(self, part: Slice) -> Iterator[tuple[str, bytes]]:
        if "://" in self.path and not self.path.startswith("file:"):
            store, path = pa.fs.FileSystem.from_uri(self.path)
            prefix = self.path.partition("://")[0] + "://"
        else:
            store, path, prefix = None, os.path.abspath(self.path.removeprefix("file://").removeprefix("file:")), "file:"
        for name in _files(path, store):
            if zlib.crc32(name.encode("utf-8", "surrogateescape")) % part.of == part.number:
                stream = open(name, "rb") if store is None else store.open_input_stream(name)
                with stream:
                    yield prefix + name.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), stream.read()

    def _rows(self, path: str, raw: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for path, raw in self._opened(partition):
            for row in self._rows(path, raw):
                held.append(row)
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)


class _TextReader(_FolderReader):
    schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("text", pa.string()), ("encoding", pa.string()), ("status", pa.string()), ("error", pa.string())])

    def _rows(self, path: str, raw: bytes) -> Iterator[tuple]:
        text, encoding = decoded(raw) if raw else ("", "utf-8")
        empty = not text.strip(" ")
        yield path, len(raw), text, encoding, "failed" if empty else "success", "empty file" if empty else ""


class _CellReader(_FolderReader):
    schema = pa.schema([("path", pa.string()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("value", pa.string()), ("status", pa.string()), ("warning", pa.string())])

    def _rows(self, path: str, raw: bytes) -> Iterator[tuple]:
        """The cells of a file, row by row: it is never held as cells in whole."""
        text = decoded(raw)[0].strip("﻿")
        delimiter, sure = sniff(text)
        warning = "" if sure else "delimiter not clear, read with commas"
        lines = (line for line in csv.reader(io.StringIO(text), delimiter=delimiter) if any(v.strip() for v in line))
        header, first = next(lines, None), next(lines, None)
        if first is None:
            yield path, 0, 0, None, "failed", "no rows"
            return
        for line_no, line in enumerate(_chained(header, first, lines)):
            for col_no, value in enumerate(line):
                yield path, line_no, col_no, value, "success", warning


def _chained(header: list[str], first: list[str], lines: Iterator[list[str]]) -> Iterator[list[str]]:
    yield header
    yield first
    yield from lines


class TextFolder(DataSource):
    """(path, size_bytes, text, encoding, status, error): the rows of ``files.read_text_files``; empty files failed."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_text"

    def schema(self) -> str:
        return TEXT

    def reader(self, schema) -> DataSourceReader:
        return _TextReader(self.options)


class CsvFolder(DataSource):
    """(path, row_no, col_no, value, status, warning): the rows of ``files.read_csv_sniffed``."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_csv"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _CellReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(TextFolder)
    spark.dataSource.register(CsvFolder)
