"""Folder scans: one inventory row per file.

Spark's own file reader leaves out empty files and names that start with ``.`` or ``_``, has no creation time and
cannot hold a file over 2 GiB in a row. All of these belong in an inventory, so directories are listed by Spark tasks,
one level of the tree per round, and contents are hashed as streams. The root is a path that every executor can
reach, or a URI of a storage that pyarrow knows (``s3://``, ``hdfs://``, ...).
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import labels
from kinfold.sources.inventory import describe
from kinfold.sources.scratch import materialize

FILES_PER_TASK = 10_000
ENTRIES_AT_ONCE = 10_000
_BLOCK = 1024 * 1024
_ENTRY = "path string, is_dir boolean, size_bytes long, created_at_raw string, modified_at_raw string, reason string"
_COLUMNS = ["path", "is_dir", "size_bytes", "created_at_raw", "modified_at_raw", "reason"]


def _remote(location: str) -> bool:
    return "://" in location and not location.startswith("file://")


def _local_path(location: str) -> str:
    """``file://`` roots are local paths, escaped."""
    return unquote(location.removeprefix("file://")) if location.startswith("file://") else location


def _text(moment: datetime | None) -> str | None:
    return moment and moment.strftime("%Y-%m-%d %H:%M:%S")


def _local_entries(directory: str) -> Iterator[tuple]:
    with os.scandir(directory) as listing:
        for entry in listing:
            try:
                if entry.is_dir():
                    linked = entry.is_symlink()
                    yield entry.path, True, None, None, None, labels.LINKED_DIR if linked else None
                    continue
                info = entry.stat()
            except OSError:  # also a link to nowhere or to itself
                yield entry.path, False, None, None, None, labels.VANISHED
                continue
            dates = [_text(datetime.fromtimestamp(moment, UTC)) for moment in (info.st_ctime, info.st_mtime)]
            yield entry.path, False, info.st_size, *dates, None


def _remote_entries(system: fs.FileSystem, directory: str) -> Iterator[tuple]:
    """Object stores know one date, the last change."""
    for info in system.get_file_info(fs.FileSelector(directory)):
        if info.type == fs.FileType.Directory:
            yield info.path, True, None, None, None, None
        else:
            yield info.path, False, info.size, _text(info.mtime), _text(info.mtime), None


def _lister(root: str, tokens: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def judged(entry: tuple) -> tuple:
        path, is_dir, *facts, reason = entry
        name = path.rsplit("/", 1)[-1]
        excluded = is_dir and not reason and any(token in name for token in tokens)
        return path, is_dir, *facts, labels.EXCLUDED if excluded else reason

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=_COLUMNS).astype({"size_bytes": "Int64"})

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(root)[0] if _remote(root) else None
        for batch in batches:
            for directory in batch["path"]:
                found: list[tuple] = []
                try:
                    for entry in _remote_entries(system, directory) if system else _local_entries(directory):
                        found.append(judged(entry))
                        if len(found) == ENTRIES_AT_ONCE:
                            yield frame(found)
                            found = []
                except OSError:  # what was listed stays
                    found.append((directory, True, None, None, None, labels.UNLISTED_DIR))
                yield frame(found)

    return entries


def _stream_md5(system: fs.FileSystem | None, path: str) -> str | None:
    """MD5 of the content; an unreadable file stays in the inventory without one."""
    try:
        if not system and not stat.S_ISREG(os.stat(path).st_mode):  # a pipe would block
            return None
        if not system:
            with open(path, "rb") as stream:
                return hashlib.file_digest(stream, "md5").hexdigest()
        digest = hashlib.md5()
        with system.open_input_stream(path, compression=None) as stream:
            while block := stream.read(_BLOCK):
                digest.update(block)
        return digest.hexdigest()
    except OSError:
        return None


def _hasher(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(root)[0] if _remote(root) else None
        for batch in batches:
            yield batch.assign(content_md5=[_stream_md5(system, path) for path in batch["path"]])

    return hashed


def _opened(root: str) -> tuple[str, str]:
    """Folder as its file system names it, and what precedes that in the paths of the inventory."""
    if not root or not root.strip():
        raise ValueError("a folder path is required")
    root = root.strip()
    if not _remote(root):
        local = _local_path(root)
        if not os.path.isdir(local):
            raise FileNotFoundError(root)
        return local.rstrip("/") or "/", "file://" if root.startswith("file://") else ""
    system, path = fs.FileSystem.from_uri(root)
    if system.get_file_info(path).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    return path, root.removesuffix(path) if root.endswith(path) else root.split("://")[0] + "://"


def _entries(spark: SparkSession, root: str, exclusions: list[str] | None) -> DataFrame:
    """Everything met below ``root``: files, and what was not taken with its reason. Nothing below the latter is met."""
    lister = _lister(root.strip(), exclusions or labels.EXCLUDED_DIRS)
    # Explicit partition counts: adaptive execution would merge such small rows into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([(_opened(root)[0],)], "path string")
    levels = []
    while not frontier.isEmpty():
        entries = materialize(frontier.repartition(tasks).mapInPandas(lister, _ENTRY), "folder-level")
        levels.append(entries.filter("NOT is_dir OR reason IS NOT NULL"))
        frontier = entries.filter("is_dir AND reason IS NULL").select("path")
    return reduce(DataFrame.unionByName, levels)


def list_folder(spark: SparkSession, root: str, exclusions: list[str] | None = None) -> DataFrame:
    """All files below ``root`` that are not under an excluded directory, with size and dates."""
    return _entries(spark, root, exclusions).filter("reason IS NULL").drop("is_dir", "reason")


def _hashed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count() // FILES_PER_TASK)
    hashed = files.repartition(tasks).mapInPandas(
        _hasher(root.strip()),
        "path string, size_bytes long, created_at_raw string, modified_at_raw string, content_md5 string",
    )
    return hashed.withColumn("path", F.concat(F.lit(_opened(root)[1]), "path"))


def scan_folder(spark: SparkSession, root: str, exclusions: list[str] | None = None) -> DataFrame:
    return describe(_hashed(spark, root, list_folder(spark, root, exclusions)))


def scan_with_rejects(
    spark: SparkSession, root: str, exclusions: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The inventory of ``scan_folder``, and ``(path, is_dir, reason)`` of what the same pass could not take.

    A file whose content cannot be read is in both: it has a size and dates, but no MD5. Every file that was met is in
    the inventory or rejected; of a directory that was left out or could not be listed to its end, only the directory is told.
    """
    entries = _entries(spark, root, exclusions)
    files = entries.filter("reason IS NULL").drop("is_dir", "reason")
    inventory = materialize(_hashed(spark, root, files), "scanned-files")
    left_out = entries.filter("reason IS NOT NULL").select(
        F.concat(F.lit(_opened(root)[1]), "path").alias("path"), "is_dir", "reason"
    )
    unread = inventory.filter("content_md5 IS NULL").select(
        "path", F.lit(False).alias("is_dir"), F.lit(labels.UNREAD).alias("reason")
    )
    return describe(inventory), left_out.unionByName(unread)
