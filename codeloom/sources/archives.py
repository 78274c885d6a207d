"""Code bases as a Spark data source: folders and ZIP archives, in parallel.

    spark.dataSource.register(CodeBases)
    spark.read.format("codebase").option("path", "/mnt/repos").load()

The driver lists names and sizes only (of an archive its directory); tasks get
lists of files of about equal bytes, and read those.  Folders that are ignored
are never entered, and files that a filter on file_path or archive rules out
are never opened.  The path must be one that driver and executors share, as a
mounted folder; for other stores there is ``scans.workspace``.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from ..functions.text import SUPPORTED_EXTENSIONS
from ..operators.guard import IGNORED_DIRECTORIES

SCHEMA = "archive string, file_path string, size bigint, content string"
#: Bytes of files that one task reads, unless an option names another number.
PARTITION_BYTES = 8 << 20
#: What a file takes at least, so that very many small ones are dealt out too.
OPEN_BYTES = 4 << 10


@dataclass
class Files(ds.InputPartition):
    """Files (archive, name within it, place to read it from, size)."""

    files: list[tuple[str, str, str, int]]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


def wanted(path: str) -> bool:
    """Whether a name within a code base is code outside of ignored folders."""
    *folders, name = path.split("/")
    return name.rpartition(".")[2] in SUPPORTED_EXTENSIONS and "." in name and not set(folders) & set(IGNORED_DIRECTORIES)


def listed(root: str) -> Iterator[tuple[str, str, str, int]]:
    """The code files of a folder, of an archive, or of all archives in a
    folder, by name."""
    if os.path.isfile(root):
        yield from _members(root)
        return
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in IGNORED_DIRECTORIES)
        for name in sorted(names):
            place = os.path.join(folder, name)
            if name.lower().endswith(".zip"):
                yield from _members(place)
            elif wanted(path := os.path.relpath(place, root).replace(os.sep, "/")):
                yield "", path, place, os.path.getsize(place)


def _members(archive: str) -> Iterator[tuple[str, str, str, int]]:
    name = os.path.basename(archive)
    name = name[:-4] if name.lower().endswith(".zip") else name
    with zipfile.ZipFile(archive) as z:
        for x in sorted(z.infolist(), key=lambda x: x.filename):
            if not x.is_dir() and wanted(x.filename):
                yield name, x.filename, archive, x.file_size


class CodeBases(ds.DataSource):
    """Options: path, and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "codebase"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return Reader(self.options.get("path", ""), int(self.options.get("partitionBytes", PARTITION_BYTES)))


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes, self.tests = path, partition_bytes, []

    def pushFilters(self, filters: list[ds.Filter]):
        """Takes what can be told from a name; gives the rest back."""
        for f in filters:
            place = {("archive",): 0, ("file_path",): 1}.get(getattr(f, "attribute", None))
            value = getattr(f, "value", None)
            if place is not None and type(f) in _TESTS and value is not None:
                self.tests.append((place, type(f).__name__, value))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        out, held, size = [], [], 0
        for file in listed(self.path):
            if not all(_BY_NAME[kind](file[place], value) for place, kind, value in self.tests):
                continue
            cost = max(OPEN_BYTES, file[3])
            if held and size + cost > self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(file)
            size += cost
        return [*out, Files(held)] if held else out

    def read(self, partition: Files | None) -> Iterator[tuple]:
        archive, place = None, None
        try:
            for name, path, at, size in partition.files if partition is not None else []:
                if name or at.lower().endswith(".zip"):
                    if at != place:
                        if archive is not None:
                            archive.close()
                        archive, place = zipfile.ZipFile(at), at
                    raw = archive.read(path)
                else:
                    with open(at, "rb") as f:
                        raw = f.read()
                yield name, path, size, raw.decode("utf-8", "replace")
        finally:
            if archive is not None:
                archive.close()


_TESTS = {
    ds.EqualTo: lambda text, value: text == value,
    ds.StringStartsWith: lambda text, value: text.startswith(value),
    ds.StringEndsWith: lambda text, value: text.endswith(value),
    ds.StringContains: lambda text, value: value in text,
    ds.In: lambda text, value: text in value,
}
_BY_NAME = {kind.__name__: test for kind, test in _TESTS.items()}


def codebases(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(archive, file_path, size, content) of the code below a folder, in its
    archives, or in one archive."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CodeBases)
    return spark.read.format("codebase").option("path", path).option("partitionBytes", partition_bytes).load()
