"""A data source that lists a folder tree in tasks: the driver sees a number of partitions and no file.

Partition i of n lists the folders above `depth` levels like the others and then walks only those entries at that level whose
path hashes to i. So a tree is split by its prefixes (patients, or patients and dates) without anyone having a list of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, length bigint, modified timestamp"
#: Files of a record batch.
BATCH = 4096


class Share(InputPartition):
    """One of `value` = (number, count) shares of the entries."""


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("name the folder to list: load(path)")
        self.root = options["path"]
        self.tasks = int(options.get("tasks", "64"))
        self.depth = max(1, int(options.get("depth", "1")))

    def partitions(self) -> list[InputPartition]:
        return [Share((i, self.tasks)) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        number, count = partition.value
        if "://" in self.root or self.root.startswith("file:"):
            prefix = self.root.split(":", 1)[0] + (":" if self.root.startswith("file:/") and not self.root.startswith("file://") else "://")
            store, root = FileSystem.from_uri(self.root)
        else:
            prefix = ""
            store, root = FileSystem.from_uri(f"file://{self.root}")
        root = root.rstrip("/")

        def files(folder: str, level: int, mine: bool) -> Iterator:
            """Files below a folder, depth first; a folder's own list is all that is held. Entries above the level of the shares belong to the share their path hashes to."""
            below = []
            for entry in store.get_file_info(FileSelector(folder)):
                here = mine or level == self.depth or entry.type != FileType.Directory
                if here and not mine and zlib.crc32(entry.path[len(root) :].encode()) % count != number:
                    continue
                if entry.type == FileType.Directory:
                    below.append((entry.path, here))
                else:
                    yield entry
            for path, taken in below:
                yield from files(path, level + 1, taken)

        held: list[tuple] = []
        for entry in files(root, 1, False):
            held.append((prefix + entry.path, entry.base_name, entry.size, entry.mtime.astimezone(timezone.utc) if entry.mtime else None))
            if len(held) == BATCH:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


_COLUMNS = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _COLUMNS.types)], schema=_COLUMNS)


class FolderListing(DataSource):
    """spark.read.format("folder_listing").option("tasks", 64).option("depth", 1).load(root): every file below root, contents unread.

    Options: `tasks`, the number of partitions; `depth`, the level of folders at which the tree is split (2 where a few first folders hold most of it).
    Local paths and the stores of pyarrow.fs (s3, gs, hdfs). A folder that cannot be read fails its task. An empty root has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options))


def list_folder(spark: SparkSession, root: str, tasks: int = 64, depth: int = 1) -> DataFrame:
    """(path, name, length, modified) of every file below root, listed in `tasks` tasks."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("tasks", tasks).option("depth", depth).load(root)
