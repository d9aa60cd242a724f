"""A folder of books as a Spark data source: ``spark.read.format("quire").load(folder)`` and its writer (SRC-01, SRC-09, SRC-18).

Rows are files: name, size and fmt from the listing, head and tail from the first and last bytes, content whole. The schema that is asked for
decides what is opened: without head, tail and content no file is; without content no file is read further than these. Options choose files by format, name and size on the
listing, while the scan is planned, so the others are not opened at all, and those chosen are dealt to partitions by the bytes that will be read of them.

Filters of a query are left to Spark: as of 4.1 it keeps what a Python source pushes down with the table, not with the scan, so that two scans of one
table with different filters, as in a union, would share the last one's files (a test keeps this). Options belong to a table of their own.

The writer puts each file aside first. Only when all tasks have succeeded are they moved to their names; a failed write leaves the folder as it was.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

FORMAT = "quire"
COLUMNS = {"name": pa.string(), "size": pa.int64(), "fmt": pa.string(), "head": pa.binary(), "tail": pa.binary(), "content": pa.binary()}
SCHEMA = "name string, size long, fmt string, head binary, tail binary, content binary"
#: Bytes of head and tail, as many as encodings and the end of a PDF are told by.
HEAD, TAIL = 8192, 2048
#: Bytes that a partition reads and that a batch holds, about; opening a file counts as so many bytes.
PARTITION, BATCH, OPENING = 64 << 20, 4 << 20, 64 << 10
MOVES = 32
STAGING = "_staging-"
#: What files of no known format are called in the option formats.
OTHER = "other"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, S3, GCS, HDFS) and the path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)


def format_of(name: str) -> str | None:
    """pdf, txt or epub, as library.format_of."""
    found = re.search(r"(?is).\.(pdf|txt|epub)\Z", name)
    return found[1].lower() if found else None


class File(NamedTuple):
    name: str
    size: int


def listed(folder: str) -> Iterator[File]:
    """Files under a folder by their names within it, folder by folder; hidden ones, and those still being written, begin with a dot or underscore."""
    where, root = file_system(folder)
    root = root.rstrip("/")
    waiting = [root]
    while waiting:
        found = sorted(where.get_file_info(fs.FileSelector(waiting.pop())), key=lambda f: f.base_name)
        found = [f for f in found if f.base_name[0] not in "._"]
        yield from (File(f.path[len(root) + 1 :], f.size) for f in found if f.type == fs.FileType.File)
        waiting += [f.path for f in reversed(found) if f.type == fs.FileType.Directory]


@dataclass
class Files(ds.InputPartition):
    files: list[File]


class Reader(ds.DataSourceReader):
    def __init__(self, folder: str, columns: list[str], options: dict[str, str]):
        self.folder, self.columns = folder, columns
        self.partition, self.head = int(options.get("partition_bytes", PARTITION)), int(options.get("head_bytes", HEAD))
        self.formats = set(options["formats"].split(",")) if "formats" in options else None
        self.prefix, self.least, self.most = options.get("prefix", ""), int(options.get("least_bytes", 0)), int(options.get("most_bytes", 1 << 62))

    def _chosen(self, file: File) -> bool:
        return (self.formats is None or (format_of(file.name) or OTHER) in self.formats) and file.name.startswith(self.prefix) and self.least <= file.size <= self.most

    def _cost(self, file: File) -> int:
        read = file.size if "content" in self.columns else min(file.size, self.head * ("head" in self.columns) + TAIL * ("tail" in self.columns))
        return read + OPENING * bool({"head", "tail", "content"} & set(self.columns))

    def partitions(self) -> list[Files]:
        groups, held = [], 0
        for file in listed(self.folder):
            if self._chosen(file):
                cost = self._cost(file)
                if not groups or held + cost > self.partition:
                    groups.append([])
                    held = 0
                groups[-1].append(file)
                held += cost
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, root = file_system(self.folder)
        schema = pa.schema([(c, COLUMNS[c]) for c in self.columns])
        rows, held = [], 0
        for file in partition.files:
            rows.append(self._row(where, root, file))
            held += self._cost(file)
            if held > BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, where: fs.FileSystem, root: str, file: File) -> dict:
        row = {"name": file.name, "size": file.size, "fmt": format_of(file.name)}
        if {"head", "tail", "content"} & set(self.columns):
            with where.open_input_file(posixpath.join(root, file.name)) as f:
                if "content" in self.columns:
                    row["content"] = f.read()
                if "head" in self.columns:
                    f.seek(0)
                    row["head"] = f.read(self.head)
                if "tail" in self.columns:
                    f.seek(max(0, file.size - TAIL))
                    row["tail"] = f.read(TAIL)
        return row


@dataclass
class Staged(ds.WriterCommitMessage):
    """Where a task put files aside."""

    folder: str


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.staging = folder, overwrite, STAGING + uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        where, root = file_system(self.folder)
        own = posixpath.join(root, self.staging, uuid.uuid4().hex)  # another attempt has another
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name or name.startswith("/") or ".." in name.split("/") or re.search(r"(^|/)[._]", name):
                    raise ValueError(f"not a name for a file of a shelf: {name!r}")
                where.create_dir(posixpath.dirname(posixpath.join(own, name)), recursive=True)
                if where.get_file_info(posixpath.join(own, name)).type != fs.FileType.NotFound:
                    raise ValueError(f"two books have the name {name}")
                with where.open_output_stream(posixpath.join(own, name)) as out:
                    out.write(content or b"")
        return Staged(own)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves task by task, so that the driver lists one task's files at a time; of all names it keeps a hash."""
        where, root = file_system(self.folder)
        tasks = [m.folder for m in messages if m and where.get_file_info(m.folder).type == fs.FileType.Directory]
        names: set[int] = set()
        for name in (f.name for t in tasks for f in listed(t)):
            before = len(names)
            names.add(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big"))
            if len(names) == before:
                self.abort(messages)
                raise ValueError(f"two books have the name {name}")
        old = [f.name for f in listed(self.folder)] if self.overwrite and where.get_file_info(root).type == fs.FileType.Directory else []
        with ThreadPoolExecutor(MOVES) as pool:
            for t in tasks:
                own = [f.name for f in listed(t)]
                for name in {posixpath.dirname(n) for n in own}:
                    where.create_dir(posixpath.join(root, name), recursive=True)
                list(pool.map(lambda n: where.move(posixpath.join(t, n), posixpath.join(root, n)), own))  # noqa: B023
            gone = (n for n in old if int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "big") not in names)
            list(pool.map(lambda n: where.delete_file(posixpath.join(root, n)), gone))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """What a task that is still running puts aside after this stays hidden."""
        where, root = file_system(self.folder)
        aside = posixpath.join(root, self.staging)
        if where.get_file_info(aside).type != fs.FileType.NotFound:
            where.delete_dir(aside)


class Shelf(ds.DataSource):
    """Options: path, the folder; of its files only those of ``formats`` (of pdf, txt, epub and other, by commas), whose names begin with ``prefix``,
    and of ``least_bytes`` to ``most_bytes``; partition_bytes, what a task reads; head_bytes, how long a head is."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        columns = schema.fieldNames()
        if set(columns) - set(COLUMNS):
            raise ValueError(f"a shelf has the columns {', '.join(COLUMNS)}")
        return Reader(self.options["path"], columns, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("a shelf is written from the columns name and content")
        return Writer(self.options["path"], overwrite)


def read(spark: SparkSession, folder: str, *columns: str, **options: object) -> DataFrame:
    """The files of a folder that the options of Shelf choose; of their ``columns`` (all, if none is named) no more is read than these need."""
    spark.dataSource.register(Shelf)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    chosen = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(FORMAT).schema(", ".join(f"{c} {kinds[c]}" for c in columns or COLUMNS)).options(**chosen).load(folder)


def write(books: DataFrame, folder: str, mode: str = "append") -> None:
    """A file for each row (name, content) of ``books``; null content is an empty file. Equal names, or names outside the folder, are an error and leave it as it was."""
    books.sparkSession.dataSource.register(Shelf)
    books.select("name", "content").write.format(FORMAT).mode(mode).save(folder)
