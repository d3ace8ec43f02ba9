"""Spark data source ``adj6``: adjacency records read by byte ranges and written as bounded files.

Records state their own length, so where they start shows only from the file's start on. Reading first follows the records' heads
(twelve bytes each, the lists between are skipped) to an index of byte ranges of about ``split_bytes``; a list longer
than that is cut inside. Every range is a partition of its own: one file, of any size, is many tasks. Writing streams
rows into files of at most ``file_edges`` edges under hidden names; a task's commit message names its files and the
driver's commit shows them, so a failed or repeated task leaves nothing behind that is read.

``path`` is a file or folder of any store that Arrow's file systems open (mounted folders, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
Empty and hidden files hold nothing; a cut-off file raises ValueError. Sort rows by (src, dst) and deal them by range before
writing to get a record for each source: records are made of neighbouring rows.

    register(spark)
    spark.read.format("adj6").load(path)
    e.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.format("adj6").mode("append").save(path)
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import formats

SPLIT_BYTES = 64 << 20
_HEAD = 12


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Adj6)


class _Folder:
    """Files of a mounted folder; the few calls of Arrow's file systems that are needed here."""

    def listed(self, path: str) -> list[tuple[str, int]]:
        names = [os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_"))] if os.path.isdir(path) else [path]
        return sorted((n, os.path.getsize(n)) for n in names if os.path.isfile(n) and os.path.getsize(n))

    def create_dir(self, path: str, recursive: bool = True) -> None:
        os.makedirs(path, exist_ok=True)

    def open_input_file(self, path: str):  # noqa: ANN202
        return pa.OSFile(path, "rb")

    def open_output_stream(self, path: str):  # noqa: ANN202
        return pa.OSFile(path, "wb")

    def delete_file(self, path: str) -> None:
        os.remove(path)

    def move(self, path: str, to: str) -> None:
        os.replace(path, to)


def _open(path: str):  # noqa: ANN202
    """The store that holds a path, and the path within it."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return _Folder(), "/" + rest.lstrip("/") if rest else path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files with anything in them: path within their store, and size."""
    store, inner = _open(path)
    if isinstance(store, _Folder):
        return store.listed(inner)
    from pyarrow import fs

    info = store.get_file_info(inner)
    found = store.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """Bytes of a file: whole records, or (with a source) targets of one record."""

    path: str
    start: int
    stop: int
    src: int | None = None

    def __init__(self, path: str, start: int, stop: int, src: int | None = None) -> None:
        self.path, self.start, self.stop, self.src = path, start, stop, src


def _six(raw: bytes) -> list[int]:
    return [int.from_bytes(raw[k : k + 6], "big") for k in range(0, len(raw), 6)]


def ranges(read_at, path: str, size: int, split_bytes: int) -> Iterator[Range]:  # noqa: ANN001
    """The index of one file: ``read_at(n, offset)`` gives bytes of it."""
    split_bytes = max(_HEAD, split_bytes // 6 * 6)
    open_at = at = 0
    while at < size:
        head = read_at(_HEAD, at)
        if len(head) < _HEAD:
            raise ValueError(f"{path} is cut off")
        src, n = _six(head)
        stop = at + _HEAD + 6 * n
        if stop > size:
            raise ValueError(f"{path} is cut off")
        if stop - at > split_bytes:
            if open_at < at:
                yield Range(path, open_at, at)
            for a in range(at + _HEAD, stop, split_bytes):
                yield Range(path, a, min(stop, a + split_bytes), src)
            open_at = stop
        elif stop - open_at > split_bytes:
            yield Range(path, open_at, at)
            open_at = at
        at = stop
    if open_at < size:
        yield Range(path, open_at, size)


class Adj6(DataSource):
    @classmethod
    def name(cls) -> str:
        return "adj6"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> Adj6Reader:  # noqa: ANN001
        return Adj6Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Adj6Writer:  # noqa: ANN001
        if [f.name for f in schema.fields] != ["src", "dst"]:
            raise ValueError("adj6 takes the columns src and dst")
        return Adj6Writer(dict(self.options), overwrite)


class Adj6Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        store, _ = _open(self.path)
        found = []
        for path, size in _listed(self.path):
            with store.open_input_file(path) as f:
                found += ranges(f.read_at, path, size, self.split_bytes)
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as f:
            numbers = formats.six_byte_numbers(f.read_at(partition.stop - partition.start, partition.start))
        columns = formats.adj6_edges(numbers, partition.path) if partition.src is None else {"src": np.full(len(numbers), partition.src), "dst": numbers}
        for rows in formats.in_rows(columns):
            yield pa.RecordBatch.from_pydict(rows)


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written: hidden name, and name once committed."""

    names: list[tuple[str, str]]


class Adj6Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.file_edges = options["path"], overwrite, int(options.get("file_edges", formats.FILE_EDGES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        names: list[tuple[str, str]] = []
        for part in formats.in_parts(iterator, self.file_edges):
            src, dst = (part.column(c).to_numpy() for c in ("src", "dst"))
            name = f"{folder}/{formats.adj6_name(src, dst)}"
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(formats.adj6_bytes(src, dst))
            names.append((hidden, name))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for path, _ in _listed(self.path):
                store.delete_file(path)
        for message in messages:
            for hidden, name in message.names if message else ():
                store.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _open(self.path)
        for message in messages:
            for hidden, _ in message.names if message else ():
                store.delete_file(hidden)
