"""A data source that lists stored files on executors, as a batch and as a stream.

The driver finds the folders of the first levels only, as many as make enough
tasks; the tasks list what lies below them. Of files it keeps nothing. As a
stream the source has a new offset at every trigger, the time of the listing,
and every micro-batch is a whole listing: what changed is for the reader to
compare, as removed files leave no trace in a store.

The module needs nothing of this package: it travels to the executors by value.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import sys
import time
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

LISTING_DDL = "path string, modified_at timestamp, n_bytes bigint"
LISTING = pa.schema(
    [("path", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("n_bytes", pa.int64())]
)
BATCH = 10_000  # files of a record batch
TASKS = 64  # listing tasks, about
SPREAD = 4  # folders a task lists, at least where there are enough


class Store:
    """Children of a folder in a local, mounted or remote store."""

    def __init__(self, path: str):
        path = path.rstrip("/") or "/"
        self.scheme = urlsplit(path).scheme
        self.remote = None
        if self.scheme not in ("", "file"):
            self.remote, self.root = fs.FileSystem.from_uri(path)
            self.prefix = path[: len(path) - len(self.root)] if path.endswith(self.root) else ""
        else:
            self.root = "/" + re.sub(r"^file:", "", path).lstrip("/")
            self.prefix = "file:"
        self.root = self.root.rstrip("/") or "/"

    def children(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        """(path, is a folder, milliseconds of its last change, bytes); files in use may go."""
        if self.remote is not None:
            for found in self.remote.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                is_folder = found.type == fs.FileType.Directory
                yield found.path, is_folder, (found.mtime_ns or 0) // 1_000_000, found.size or 0
            return
        try:
            with os.scandir(folder) as entries:
                for entry in entries:
                    try:
                        if entry.is_dir():
                            yield entry.path, True, 0, 0
                        else:
                            status = entry.stat()
                            yield entry.path, False, status.st_mtime_ns // 1_000_000, status.st_size
                    except FileNotFoundError:
                        continue
        except FileNotFoundError:
            return

    def folders(self, folder: str) -> list[str]:
        """Folders in a folder; files are passed over without their status."""
        if self.remote is not None:
            return [path for path, is_folder, *_ in self.children(folder) if is_folder]
        try:
            with os.scandir(folder) as entries:
                return [entry.path for entry in entries if entry.is_dir()]
        except FileNotFoundError:
            return []


def hidden(path: str) -> bool:
    """Whether Spark's own readers pass over a file or folder of this name."""
    name = path.rsplit("/", 1)[-1]
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def name_pattern(glob: str | None) -> re.Pattern | None:
    """A file name pattern with ``*``, ``?``, ``[...]`` and ``{a,b}``."""
    if not glob:
        return None
    choices = [""]
    for part in re.split(r"(\{[^{}]*\})", glob):
        ends = part[1:-1].split(",") if part.startswith("{") else [part]
        choices = [begin + end for begin in choices for end in ends]
    return re.compile("|".join(fnmatch.translate(choice) for choice in choices))


def listing_tasks(paths: Sequence[str], tasks: int = TASKS) -> list[list[tuple[str, str, bool]]]:
    """(path, folder, with all below it) by task, from folder names alone.

    Levels of folders are opened until there are enough for all tasks. An
    opened folder is listed for its own files; the last level with all below.
    Neighbours go to different tasks.
    """
    work: list[tuple[str, str, bool]] = []
    frontier = [(path, Store(path).root) for path in paths]
    stores = {path: Store(path) for path in paths}
    while 0 < len(frontier) < SPREAD * tasks:
        below = [
            (path, child)
            for path, folder in frontier
            for child in stores[path].folders(folder)
            if not hidden(child)
        ]
        work += [(path, folder, False) for path, folder in frontier]
        frontier = below
    work += [(path, folder, True) for path, folder in frontier]
    count = max(1, min(tasks, len(work)))
    return [work[number::count] for number in range(count)]


def files_below(path: str, folder: str, deep: bool, glob: str | None) -> Iterator[tuple]:
    """(path, milliseconds, bytes) of a folder's files, and with ``deep`` of all below it."""
    store, pattern, open_ = Store(path), name_pattern(glob), [folder]
    while open_:
        for child, is_folder, modified, size in store.children(open_.pop()):
            if hidden(child):
                continue
            if is_folder:
                if deep:
                    open_.append(child)
            elif pattern is None or pattern.match(child.rsplit("/", 1)[-1]):
                yield store.prefix + child, modified, size


def record_batches(work: list[tuple[str, str, bool]], glob: str | None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        paths, modified, sizes = zip(*rows)
        times = pa.array([1000 * ms for ms in modified], LISTING.field(1).type)
        return pa.RecordBatch.from_arrays([pa.array(paths), times, pa.array(sizes)], schema=LISTING)

    for path, folder, deep in work:
        for row in files_below(path, folder, deep, glob):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


class Listing:
    """What both readers share: the paths, the glob, and the work of a partition."""

    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.glob = options.get("glob") or None
        self.tasks = int(options.get("tasks", TASKS))

    def work(self) -> list[InputPartition]:
        return [InputPartition(some) for some in listing_tasks(self.paths, self.tasks)]


class ListingReader(Listing, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.work()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return record_batches(partition.value, self.glob)


class ListingStreamReader(Listing, DataSourceStreamReader):
    """An offset is the time of a listing in milliseconds."""

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.work()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return record_batches(partition.value, self.glob)

    def commit(self, end: dict) -> None:
        """Nothing is kept between listings."""


class FolderListing(DataSource):
    """``folder_listing``: options ``paths`` (a JSON list), ``glob``, ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING_DDL

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStreamReader:
        return ListingStreamReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def listing_options(paths: Sequence[str], glob: str | None, tasks: int | None = None) -> dict:
    options = {"paths": json.dumps(list(paths))}
    if glob:
        options["glob"] = glob
    if tasks:
        options["tasks"] = str(tasks)
    return options


def register_listing(spark: SparkSession) -> str:
    """Make the source known to a session; returns its name."""
    spark.dataSource.register(FolderListing)
    return FolderListing.name()
