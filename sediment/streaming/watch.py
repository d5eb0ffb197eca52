"""Changed files of watched folders as a stream, restarted from its checkpoint without loss or repeat.

    spark.dataSource.register(FileChanges)
    spark.readStream.format("file_changes").option("roots", '["/archive"]').load()

Columns: root, path, name, size, kind, changed_at. An offset is a moment: a batch has the files that changed after its
start and up to its end, so the driver keeps no list of files, and each task walks a part of the folders by itself.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import scalar as S
from .events import debounce
from .jobs import asked_by_events

CHANGE = "root string, path string, name string, size long, kind string, changed_at timestamp"


class Folder(InputPartition):
    """A part of a root: the folder alone, or all below it."""

    def __init__(self, root: str, path: str, deep: bool, after: int, until: int):
        self.root, self.path, self.deep, self.after, self.until = root, path, deep, after, until


def files_below(path: str, deep: bool) -> Iterator[os.DirEntry]:
    """Files of a folder, and of those below it if deep; links to folders are not followed, what vanishes or is closed is skipped."""
    left = [path]
    while left:
        try:
            with os.scandir(left.pop()) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        left += [e.path] * deep
                    elif e.is_file():
                        yield e
        except OSError:
            continue


class ChangeReader(DataSourceStreamReader):
    """Options: roots (a JSON list of folders), settle (seconds, 1: how long a change must be past to be in a batch), start
    (seconds since 1970, 0: changes up to it are left out), levels (2: folders so many levels down are tasks of their own).

    A change's time is that of the file's entry (ctime), which no program sets: so files that are moved in or copied with
    an old date, or dated ahead, are seen when they come. Batches end settle seconds ago: what changes later gets a later time, on one clock; on
    shared file systems settle has to cover how far their clocks are apart. If a batch runs again, a file that has changed
    since comes in a later batch instead. Polling doesn't tell new files from changed ones (kind is created in the first
    batch, then modified), and doesn't see deletions, which ask for no job.
    """

    def __init__(self, options: dict):
        self.roots = [r if r == "/" else r.rstrip("/") for r in json.loads(options["roots"])]
        self.settle, self.start = float(options.get("settle", 1)), float(options.get("start", 0))
        self.levels = int(options.get("levels", 2))

    def initialOffset(self) -> dict:
        return {"ns": int(self.start * 1e9)}

    def latestOffset(self) -> dict:
        return {"ns": max(time.time_ns() - int(self.settle * 1e9), int(self.start * 1e9))}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        out = []
        for root in self.roots:
            level = [root]
            for _ in range(self.levels):
                out += [Folder(root, p, False, start["ns"], end["ns"]) for p in level]
                level = [q for p in level for q in subfolders(p)]
            out += [Folder(root, p, True, start["ns"], end["ns"]) for p in level]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        first = partition.after == int(self.start * 1e9)
        for e in files_below(partition.path, partition.deep):
            try:
                s = e.stat()
            except OSError:
                continue
            if partition.after < s.st_ctime_ns <= partition.until:
                yield partition.root, e.path, e.name, s.st_size, "created" if first else "modified", datetime.fromtimestamp(s.st_ctime_ns / 1e9, UTC)

    def commit(self, end: dict) -> None:
        pass


def subfolders(path: str) -> list[str]:
    try:
        with os.scandir(path) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options)


def changes(spark: SparkSession, roots: list[str], **options: object) -> DataFrame:
    """The stream of changed files of some folders."""
    spark.dataSource.register(FileChanges)
    read = spark.readStream.format("file_changes").option("roots", json.dumps(roots))
    for k, v in options.items():
        read = read.option(k, str(v))
    return read.load()


def wanted(found: DataFrame, depth: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Changes that a source asks for: not excluded, deep enough in the root, of a wanted extension (none named: of any)."""
    name = F.col("name")
    ext = F.lower(F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1)).otherwise(""))
    kept = found.filter(S.included(F.col("path"), name, watcher=True) & S.depth_ok(F.col("root"), F.col("path"), depth))
    return kept.filter(ext.isin(*[t.lower() for t in types])) if types else kept


def jobs_of(found: DataFrame, gap: float = 2.0, lateness: str = "10 minutes") -> DataFrame:
    """The jobs that a stream of changes asks for, each path debounced; a job's id is that of its path and change, so it's asked for once."""
    calm = debounce(found, "path", "changed_at", gap, lateness).withColumn("kind", F.lit("modified"))
    out = asked_by_events(calm)
    at = F.unix_micros("accepted_at").cast("string")
    return out.select(S.generate_id("job", F.concat_ws("|", "path", at)).alias("job_id"), "job_type", F.lit("pending").alias("status"), "priority", F.to_json(F.struct("path")).alias("payload"), F.col("accepted_at").alias("created_at"))
