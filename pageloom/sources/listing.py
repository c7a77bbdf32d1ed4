"""A data source that lists the files below directories.

``spark.read.format("mirror_files").option("directories", json).load()`` gives
``(path, root, inner, size)`` of every file, whatever its name. A partition is some directories and what
lies below them. The driver opens directories only until there are enough for all tasks
(``MOST_OPENED`` at most) and keeps their names; the rest of the tree is walked in tasks, and rows
leave a task directory by directory. Filters on ``path`` (equal, one of, starts, ends, contains) reach
the source: other files give no rows, and directories that cannot hold a path with the
wanted beginning are not opened.

Links to directories are not followed, so a link to a parent adds nothing; links to files count as files,
broken ones too. A directory that cannot be listed is a row itself, and an error when it is read.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

FORMAT = "mirror_files"
# Names below a root are kept apart from it, as they may not be valid in a URI.
SCHEMA = "path string, root string, inner string, size long"
MOST_OPENED = 1000  # directories that the driver lists
PARTITIONS = 64  # that it tries to get from them
BATCH_ROWS = 10_000


def as_root(directory: object) -> str:
    root = str(directory).rstrip("/") or "/"
    return "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root


def entries(system: FileSystem, inner: str) -> list[tuple[str, bool, int]]:
    """``(inner, is_directory, size)`` of what lies directly in a directory; links to directories are left out."""
    if not isinstance(system, LocalFileSystem):
        return [(e.path, e.type == FileType.Directory, e.size or 0) for e in system.get_file_info(FileSelector(inner))]
    found = []
    with os.scandir(inner) as listed:
        for entry in listed:
            try:
                if entry.is_symlink() and entry.is_dir():
                    continue
                directory = entry.is_dir(follow_symlinks=False)
                found.append((entry.path, directory, 0 if directory else entry.stat().st_size))
            except OSError:  # a broken link
                found.append((entry.path, False, 0))
    return found


@dataclass(frozen=True)
class Walk:
    """A directory to be listed, with or without what lies in directories below it."""

    root: str
    prefix: str  # of the paths, before the names below the root
    directory: str
    deep: bool = True


@dataclass
class Walks(InputPartition):
    walks: tuple[Walk, ...]


class ListingReader(DataSourceReader):
    def __init__(self, directories: Sequence[str], partitions: int) -> None:
        self.directories, self.wanted = directories, partitions
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for one in filters:
            if type(one) in kinds and one.attribute == ("path",):
                self.tests.append((kinds[type(one)], one.value))
            elif not (isinstance(one, IsNotNull) and one.attribute == ("path",)):  # every row has a path
                yield one

    def keeps(self, path: str) -> bool:
        tests = {
            "equal": lambda value: path == value,
            "in": lambda value: path in value,
            "starts": path.startswith,
            "ends": path.endswith,
            "contains": lambda value: value in path,
        }
        return all(tests[kind](value) for kind, value in self.tests)

    def opens(self, path: str) -> bool:
        """Whether a directory can hold a path that is kept."""
        inside = path.rstrip("/") + "/"
        for kind, value in self.tests:
            starts = {"equal": [value], "starts": [value], "in": value}.get(kind)
            if starts is not None and not any(v.startswith(inside) or inside.startswith(v) and kind == "starts" for v in starts):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        waiting, opened = deque(), []
        for root in self.directories:
            inner = FileSystem.from_uri(root)[1]
            waiting.append(Walk(root, root[: len(root) - len(inner)], inner))
        # Breadth first, so that a deep directory does not keep the others waiting. Files are left to the tasks.
        while waiting and len(waiting) < self.wanted and len(opened) < MOST_OPENED:
            one = waiting.popleft()
            if self.opens(one.prefix + one.directory):
                opened.append(replace(one, deep=False))
                below = [inner for inner, directory, _ in self.listed(one) if directory]
                waiting.extend(Walk(one.root, one.prefix, inner) for inner in below)
        walks = [*waiting, *opened]
        return [Walks(tuple(walks[at :: self.wanted])) for at in range(max(1, min(self.wanted, len(walks))))]

    def listed(self, walk: Walk) -> list[tuple[str, bool, int]]:
        try:
            return entries(FileSystem.from_uri(walk.root)[0], walk.directory)
        except OSError:
            return [(walk.directory, False, 0)]

    def read(self, partition: Walks) -> Iterator[pa.RecordBatch]:
        waiting = list(partition.walks)
        while waiting:
            one = waiting.pop()
            if not self.opens(one.prefix + one.directory):
                continue
            found = self.listed(one)
            if one.deep:
                waiting.extend(replace(one, directory=inner) for inner, directory, _ in found if directory)
            files = [(one.prefix + inner, one.root, inner, size) for inner, directory, size in found if not directory]
            files = [row for row in files if self.keeps(row[0])]
            for at in range(0, len(files), BATCH_ROWS):
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*files[at : at + BATCH_ROWS]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "root", "inner", "size"])


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(json.loads(self.options["directories"]), int(self.options.get("partitions", PARTITIONS)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its filters."""
    spark.dataSource.register(FileListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
