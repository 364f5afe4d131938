"""Enumerating the files below a folder, a level a round, with links told apart and never followed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce
from stat import S_ISDIR, S_ISLNK, S_ISREG

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable

FOUND = "path string, kind string, bytes long, modified timestamp, is_link boolean, file_id string"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("is_link", pa.bool_()), ("file_id", pa.string())])


def _local(top: str, folder: str) -> Iterator[dict]:
    try:
        entries = list(os.scandir(os.path.join(top, folder)))
    except OSError:
        yield {"path": folder, "kind": "unreadable"}
        return
    for e in entries:
        s = e.stat(follow_symlinks=False)
        kind = "link" if S_ISLNK(s.st_mode) else "directory" if S_ISDIR(s.st_mode) else "file" if S_ISREG(s.st_mode) else "other"
        modified = datetime.fromtimestamp(s.st_mtime, timezone.utc)
        yield {"path": f"{folder}/{e.name}".lstrip("/"), "kind": kind, "bytes": s.st_size if kind == "file" else None, "modified": modified, "is_link": kind == "link", "file_id": f"{s.st_dev}:{s.st_ino}"}


def _remote(root: str, folder: str) -> Iterator[dict]:
    """Stores without links and file ids."""
    store, base = fs.FileSystem.from_uri(f"{root}/{folder}".rstrip("/"))
    try:
        entries = store.get_file_info(fs.FileSelector(base))
    except OSError:
        yield {"path": folder, "kind": "unreadable"}
        return
    for e in entries:
        kind = "directory" if e.type == fs.FileType.Directory else "file"
        yield {"path": f"{folder}/{e.base_name}".lstrip("/"), "kind": kind, "bytes": e.size if kind == "file" else None, "modified": e.mtime, "is_link": False, "file_id": None}


def walk(spark: SparkSession, root: str) -> DataFrame:
    """FOUND of everything below ``root`` (a URI): paths below it with slashes; kind file, directory, link, other, or unreadable for
    a folder that can't be listed.

    The frontier of folders is a DataFrame: its folders are listed by the executors, and the folders among what they find are
    the next one, so there are as many rounds as levels. A link is never followed, whatever it leads to.
    """
    local = root.startswith("file:") or "://" not in root
    top = root.removeprefix("file://").removeprefix("file:") if local else root.rstrip("/")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                rows = list(_local(top, folder) if local else _remote(top, folder))
                yield pa.RecordBatch.from_pylist([dict.fromkeys(_ARROW.names) | {"is_link": False} | r for r in rows], _ARROW)

    frontier, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        levels.append(durable(frontier.repartition("path").mapInArrow(scan, FOUND)))
        frontier = levels[-1].where("kind = 'directory'").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def regular_files(found: DataFrame, pattern: str | None = None) -> DataFrame:
    """path, bytes, modified and file_id of the regular files, those whose name matches ``pattern`` (a regular expression)."""
    files = found.where("kind = 'file'")
    if pattern is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{pattern})$"))
    return files.select("path", "bytes", "modified", "file_id")


def shared_files(found: DataFrame) -> DataFrame:
    """file_id and paths of files that stand under several names (hard links)."""
    named = found.where("kind = 'file' AND file_id IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("names"), F.min("path").alias("first"))
    return named.where("names > 1")
