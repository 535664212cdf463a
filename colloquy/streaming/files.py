"""A streaming source of files that are new or were edited, which Spark's own file source passes over."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.shared import open_fs

SCHEMA = "file_path string, modified long, size long, content_hash string, content binary"


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path in the file system, time of change in nanoseconds, size)."""

    own: list[tuple[str, int, int]]


class ChangedFiles(DataSource):
    """Options: path (a folder, read with all below it), suffixes (comma-separated, all if empty), bytes (of a task's files, 64 MB),
    settle (seconds that a file must have been left alone, 1)."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    """An offset is a time of change: a batch holds the files last changed after its start and up to its end.

    A file that is edited again before its batch is read has a newer time and comes with a later batch, in its newest form; a
    batch that is planned again holds the same files but for those. Times within the last ``settle`` seconds are left for the
    next batch, so that no file of the same tick is missed.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.most, self.settle = int(options.get("bytes", 1 << 26)), float(options.get("settle", 1))

    def _listed(self) -> list[tuple[str, int, int]]:
        fs, base = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        return sorted((f.path, f.mtime_ns, f.size) for f in found if f.type == pafs.FileType.File and (not self.suffixes or f.path.endswith(self.suffixes)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        until = time.time_ns() - int(self.settle * 1e9)
        return {"modified": max((t for _, t, _ in self._listed() if t <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, size = [], 0
        for f in self._listed():
            if start["modified"] < f[1] <= end["modified"]:
                if not out or size + f[2] > self.most:
                    out.append(Files([]))
                    size = 0
                out[-1].own.append(f)
                size += f[2]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = open_fs(self.path)
        for path, modified, size in partition.own:
            try:
                with fs.open_input_stream(path) as f:
                    data = f.read()
            except FileNotFoundError:
                continue  # deleted meanwhile
            yield path, modified, size, hashlib.sha256(data).hexdigest(), data

    def commit(self, end: dict) -> None:
        pass


def changed_files(spark: SparkSession, path: str, **options):
    """A stream (file_path, modified, size, content_hash, content) of a folder's files, again whenever one is edited."""
    spark.dataSource.register(ChangedFiles)
    reader = spark.readStream.format("changed_files").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
