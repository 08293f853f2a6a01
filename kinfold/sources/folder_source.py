"""Folders as a data source of Spark, for tables and for streams of arriving files.

``register(spark)`` makes ``spark.read.format("kinfold_folder").load(root)`` and ``spark.readStream`` of the same name known;
``read_folder`` and ``stream_folder`` give the raw inventory, as ``folder.scan_folder`` does. Options: ``exclusions``
(comma-separated), ``tasks`` and, for streams, ``lag`` (seconds).

The driver lists directories only until there is a part for every task. A part is a directory's own files, a whole subtree,
or a share of the entries of a directory with many of them: its tasks all list it, and each takes the names that fall to it,
with the subtrees below. Names of files never gather at the driver.

A stream's batch has the files whose last change lies between two seconds, so it can be read again. That change is the
storage's: on local and shared folders any write, rename or move into the folder; on object stores the write. A second is given
out once ``lag`` seconds have passed, which must cover the difference of the clocks. A file that is changed again comes again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kinfold import labels
from kinfold.sources import folder
from kinfold.sources.inventory import describe

NAME = "kinfold_folder"
TASKS = 64
#: A directory with more entries is shared by several tasks.
MANY = 1_000
LAG = 2
_SCHEMA = "path string, size_bytes long, created_at_raw string, modified_at_raw string, content_md5 string"
_NEVER = "0000-00-00 00:00:00"


@dataclass
class Part(InputPartition):
    """Entries of a directory whose name falls to ``share`` of ``of``; with the subtrees below them if ``deep``."""

    directory: str
    deep: bool = True
    share: int = 0
    of: int = 1
    since: str | None = None
    until: str | None = None


@dataclass
class _Folder:
    root: str
    exclusions: list[str]
    tasks: int

    def system(self) -> fs.FileSystem | None:
        return fs.FileSystem.from_uri(self.root)[0] if folder._remote(self.root) else None

    def entries(self, system: fs.FileSystem | None, directory: str) -> Iterator[tuple]:
        """What is to be taken of a directory; one that cannot be listed costs only itself."""
        try:
            for entry in folder._remote_entries(system, directory) if system else folder._local_entries(directory):
                path, is_dir, *_, reason = entry
                name = path.rsplit("/", 1)[-1]
                if not reason and not (is_dir and any(token in name for token in self.exclusions)):
                    yield entry
        except OSError:
            return

    def plan(self) -> list[Part]:
        system = self.system()
        done, open_parts = [], [Part(folder._opened(self.root)[0])]
        while open_parts and len(done) + len(open_parts) < self.tasks:
            part = open_parts.pop(0)
            count, below = 0, []
            for path, is_dir, *_ in self.entries(system, part.directory):
                count += 1
                if is_dir and count <= MANY:
                    below.append(path)
            if count > MANY:
                of = min(self.tasks, count // MANY + 1)
                done += [Part(part.directory, True, share, of) for share in range(of)]
            else:
                done.append(Part(part.directory, False))
                open_parts += [Part(path) for path in below]
        return done + open_parts

    def rows(self, part: Part) -> Iterator[tuple]:
        system, prefix = self.system(), folder._opened(self.root)[1]
        directories = [part.directory]
        while directories:
            directory = directories.pop()
            for path, is_dir, size, created, modified, _ in self.entries(system, directory):
                at_top = directory == part.directory
                if at_top and zlib.crc32(path.rsplit("/", 1)[-1].encode("utf-8", "surrogateescape")) % part.of != part.share:
                    continue
                if is_dir:
                    if part.deep:
                        directories.append(path)
                elif part.until is None or part.since < (created or _NEVER) <= part.until:
                    yield prefix + path, size, created, modified, folder._stream_md5(system, path)


class _Reader(DataSourceReader):
    def __init__(self, source: _Folder):
        self.source = source

    def partitions(self) -> list[Part]:
        return self.source.plan()

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.source.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: _Folder, lag: int):
        self.source, self.lag = source, lag

    def initialOffset(self) -> dict:
        return {"until": ""}

    def latestOffset(self) -> dict:
        return {"until": folder._text(datetime.now(UTC) - timedelta(seconds=self.lag))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = self.source.plan()
        for part in parts:
            part.since, part.until = start["until"], end["until"]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.source.rows(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def _folder(self) -> _Folder:
        root = (self.options.get("path") or "").strip()
        given = [token for token in self.options.get("exclusions", "").split(",") if token]
        tasks = int(self.options.get("tasks", TASKS))
        if tasks < 1:
            raise ValueError("tasks must be at least 1")
        folder._opened(root)  # no root, or one that is not there, is an error at once
        return _Folder(root, given or labels.EXCLUDED_DIRS, tasks)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        lag = int(self.options.get("lag", LAG))
        if lag < 1:
            raise ValueError("lag must be at least 1: a second has to be over")
        return _StreamReader(self._folder(), lag)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)


def read_folder(spark: SparkSession, root: str, **options) -> DataFrame:
    register(spark)
    return describe(spark.read.format(NAME).options(**options).load(root))


def stream_folder(spark: SparkSession, root: str, **options) -> DataFrame:
    register(spark)
    return describe(spark.readStream.format(NAME).options(**options).load(root))
