"""Folders as tables and tables as folders (S-1, K-3, K-6).

Both are Python data sources: what they list, read and write, they do inside tasks, through
``pyarrow.fs``, so a folder may be local (one that all executors see) or a URI of
HDFS, S3 or GCS.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    StringStartsWith, WriterCommitMessage)

#: Characters of content, and rows, handed on at once.
BATCH_CHARS, BATCH_ROWS = 8 << 20, 4096
#: Folders that the driver looks for before it leaves the rest to tasks.
LEAST_FOLDERS = 64


def open_folder(uri: str):
    """``(file system, folder without a slash at its end)``."""
    from pyarrow import fs

    if re.match(r"^file:/*", uri):
        uri = re.sub(r"^file:/*", "/", uri)
    system, base = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))
    return system, base.rstrip("/")


class Folders(InputPartition):
    """Folders of one task, relative to the root; ``deep`` ones with everything below."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.includes = json.loads(options.get("includes", "null"))
        self.excludes = json.loads(options.get("excludes", "null"))
        self.content = options.get("content", "true") == "true"
        self.parts = int(options.get("partitions", "0"))
        self.begins: str | None = None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Folders that cannot hold the paths asked for are not listed; Spark still applies every filter."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.begins = f.value
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            yield f

    def _wanted(self, folder: str) -> bool:
        below = folder + "/" if folder else ""
        if self.begins is not None and not (below.startswith(self.begins) or self.begins.startswith(below)):
            return False
        return self.only is None or any(p.startswith(below) for p in self.only)

    def _listed(self, system, base: str, folder: str):
        """``(sub-folders, files)`` of a folder, by name; names that begin with ``_`` or ``.`` too."""
        from pyarrow import fs

        infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        infos.sort(key=lambda i: i.base_name)
        rel = lambda i: f"{folder}/{i.base_name}" if folder else i.base_name
        return [rel(i) for i in infos if i.type == fs.FileType.Directory], [(rel(i), i) for i in infos if i.type == fs.FileType.File]

    def partitions(self):
        """The driver lists level by level until there are folders enough to share out, and no further."""
        system, base = open_folder(self.root)
        flat, deep = [], [""]
        while 0 < len(deep) < (self.parts or LEAST_FOLDERS):
            below = []
            for folder in deep:
                flat.append((folder, False))
                below += [f for f in self._listed(system, base, folder)[0] if self._wanted(f)]
            deep = below
        folders = flat + [(f, True) for f in deep]
        n = min(len(folders), self.parts or LEAST_FOLDERS) or 1
        return [Folders(folders[i::n]) for i in range(n)]

    def read(self, partition):
        system, base = open_folder(self.root)
        rows, size = [], 0
        for folder, deep in partition.folders:
            todo = [folder]
            while todo:
                at = todo.pop()
                below, files = self._listed(system, base, at)
                if deep:
                    todo += [f for f in reversed(below) if self._wanted(f)]
                for path, info in files:
                    if not self._kept(path, info.base_name):
                        continue
                    text = None
                    if self.content:
                        with system.open_input_stream(f"{base}/{path}", compression=None) as f:
                            text = f.read().decode("utf-8", "replace")
                    rows.append((path, info.size, info.mtime, text))
                    size += len(text or "")
                    if size >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                        yield self._batch(rows)
                        rows, size = [], 0
        yield self._batch(rows)

    def _kept(self, path: str, name: str) -> bool:
        if (self.begins is not None and not path.startswith(self.begins)) or (self.only is not None and path not in self.only):
            return False
        match = lambda globs: any(fnmatch.fnmatchcase(name, g) for g in globs)
        return (self.includes is None or match(self.includes)) and not (self.excludes and match(self.excludes))

    @staticmethod
    def _batch(rows):
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "size", "modified", "content"])


class DocumentWriter(DataSourceArrowWriter):
    """Tasks write one file for each stretch of a document that they hold, and a list of them; the driver joins the
    stretches of a document, in the order of the tasks, and gives each its name."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        system, base = open_folder(self.folder)
        number = TaskContext.get().partitionId()
        own = f"{base}/{self.staging}/{number:08d}-{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        name, out, files = None, None, 0
        with system.open_output_stream(f"{own}/list", compression=None) as listed:
            for batch in iterator:
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if path != name or out is None:
                        if path is None or path.startswith(("/", "_staging-")) or ".." in path.split("/") or not path:
                            raise ValueError(f"{path!r} cannot name a document")
                        if out is not None:
                            out.close()
                        name, out = path, system.open_output_stream(f"{own}/{files}", compression=None)
                        listed.write((json.dumps([path, f"{own}/{files}"]) + "\n").encode())
                        files += 1
                    out.write((text or "").encode())
            if out is not None:
                out.close()
        return Written(number, f"{own}/list")

    def commit(self, messages):
        system, base = open_folder(self.folder)
        name, parts, made = None, [], set()

        def close():
            if name is None:
                return
            target = f"{base}/{name}{self.suffix}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                if len(made) >= 10_000:
                    made.clear()
                made.add(folder)
            if len(parts) > 1:  # only documents that lie in several tasks are written again
                whole = f"{parts[0]}-whole"
                with system.open_output_stream(whole, compression=None) as out:
                    for part in parts:
                        with system.open_input_stream(part, compression=None) as f:
                            while data := f.read(1 << 20):
                                out.write(data)
                parts[0] = whole
            system.move(parts[0], target)

        for message in sorted((m for m in messages if m is not None), key=lambda m: m.number):
            with system.open_input_stream(message.listed, compression=None) as f:
                for line in _lines(f):
                    path, part = json.loads(line)
                    if path != name:
                        close()
                        name, parts = path, []
                    parts.append(part)
        close()
        self._clear(system, base)

    def abort(self, messages):
        self._clear(*open_folder(self.folder))

    def _clear(self, system, base):
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.staging}")


class Written(WriterCommitMessage):
    def __init__(self, number: int, listed: str):
        self.number, self.listed = number, listed


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(1 << 16):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


class FolderSource(DataSource):
    """Reads a folder as ``path, size, modified, content``; writes two columns, name and text, as files."""

    @classmethod
    def name(cls):
        return "quire_folder"

    def schema(self):
        return "path string, size bigint, modified timestamp, content string"

    def reader(self, schema):
        return FolderReader(self.options)

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options, overwrite)


def scan_folder(spark: SparkSession, root: str, includes: Sequence[str] | None = None, excludes: Sequence[str] | None = None,
                content: bool = True, partitions: int | None = None) -> DataFrame:
    """S-1: ``(path, size, modified, content)`` of every file under ``root``, names that begin with ``_`` or ``.`` included.

    ``path`` is relative to ``root``; ``content`` is decoded as UTF-8, wrong bytes replaced.  ``includes`` and ``excludes``
    are globs on names.  Folders are shared out over tasks, which list and read them; conditions on
    ``path`` (equal, in, begins with) reach the listing.  Files below linked folders are listed as the file system does.
    """
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("quire_folder").option("content", str(content).lower())
    for name, globs in (("includes", includes), ("excludes", excludes)):
        if globs is not None:
            reader = reader.option(name, json.dumps(list(globs)))
    if partitions:
        reader = reader.option("partitions", str(partitions))
    return reader.load(root)


def write_documents(rows: DataFrame, folder: str, path: str = "path", order: str = "number", text: str = "text", suffix: str = "") -> None:
    """K-3, K-6: one file ``folder/path + suffix`` for each value of ``path``: its texts by ``order``, one after the other.

    Rows are dealt by a range of ``(path, order)``, so a document of any size is written by several tasks, and the parts are
    joined when all have succeeded.  Attempts that failed leave nothing, nor does a job that failed.  A null text
    is empty; a null or empty path, or one that leaves the folder, fails the job.  An older file of that name is replaced.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FolderSource)
    dealt = rows.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text"), F.col(order).alias("_order"))
    dealt = dealt.repartitionByRange("path", "_order").sortWithinPartitions("path", "_order").drop("_order")
    dealt.write.format("quire_folder").option("suffix", suffix).mode("append").save(folder)
