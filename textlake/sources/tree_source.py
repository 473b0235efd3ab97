"""Trees of source files as a Spark data source, in batch and as a stream.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("roots", '["/data/projects"]').load()
    spark.readStream.format("source_tree").option("roots", '["/data/projects"]').load()

Rows are (path, content, length, modified, error): one of content and error is NULL, and a folder that can't be listed
is a row too. The driver lists the uppermost ``depth`` levels only, to plan a partition for each folder there; tasks
walk what is below and read the contents, so that no list of files is held anywhere.

The offsets of a stream are times: a micro-batch gives the files whose modification time is after the last offset, so
that a file comes again when it is changed, and one that comes again after a failure reads the same times. An offset
stays ``settle`` seconds behind the clock, for files that are being written. A file that is moved into the tree with an
old time is seen by the batch form only.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import SKIP_DIRS, list_folder, read_file

SCHEMA = "path string, content binary, length bigint, modified timestamp, error string"


class Folder(InputPartition):
    """A folder with the files modified after ``start`` and up to ``end``, with all below it or, if ``flat``, without."""

    def __init__(self, path: str, flat: bool, start: float, end: float):
        self.path, self.flat, self.start, self.end = path, flat, start, end


class _Tree:
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.suffix = options.get("suffix", ".ea")
        self.skip = set(json.loads(options["skip_dirs"])) if "skip_dirs" in options else set(SKIP_DIRS)
        self.depth = int(options.get("depth", 1))
        self.settle = float(options.get("settle", 2.0))

    def plan(self, start: float, end: float) -> list[Folder]:
        level, out = [r.rstrip("/") or "/" for r in self.roots], []
        for _ in range(self.depth):
            # A folder that can't be listed here is met again, and reported, by the task that gets it.
            out += [Folder(f, True, start, end) for f in level]
            level = [path for f in level for path, name, is_dir, *_ in self._try(f) if is_dir and name not in self.skip]
        return out + [Folder(f, False, start, end) for f in level]

    @staticmethod
    def _try(folder: str) -> list[tuple]:
        try:
            return sorted(list_folder(folder), key=lambda f: f[0])
        except OSError:
            return []

    def read(self, partition: Folder) -> Iterator[tuple]:
        waiting = [partition.path]
        while waiting:
            folder = waiting.pop()
            try:
                found = list_folder(folder)
            except OSError as e:
                yield folder, None, None, None, str(e)
                continue
            for path, name, is_dir, length, modified in sorted(found, key=lambda f: f[0]):
                if is_dir and not partition.flat and name not in self.skip:
                    waiting.append(path)
                if not is_dir and name.endswith(self.suffix) and modified and partition.start < modified.timestamp() <= partition.end:
                    yield self._row(path, length, modified)

    @staticmethod
    def _row(path: str, length: int, modified: datetime.datetime) -> tuple:
        try:
            return path, read_file(path), length, modified, None
        except OSError as e:
            return path, None, length, modified, str(e)


class _Batch(_Tree, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.plan(float("-inf"), float("inf"))


class _Stream(_Tree, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": -1.0}

    def latestOffset(self) -> dict:
        return {"until": round(time.time() - self.settle, 6)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.plan(start["until"], end["until"])

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
