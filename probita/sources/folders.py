"""Folder listings as a table: a Python data source that lists sub-folders, and reads the headers of files, in tasks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class _Part(InputPartition):
    folder: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        folder = options["path"].rstrip("/")
        self.folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        self.pattern = options.get("pattern", "*")
        self.deep, self.header = (options.get(k, "false").lower() == "true" for k in ("deep", "header"))

    def _found(self, folder: str | None, deep: bool) -> tuple[fs.FileSystem, str, list[fs.FileInfo]]:
        store, root = fs.FileSystem.from_uri(self.folder)
        return store, self.folder.removesuffix(root), store.get_file_info(fs.FileSelector(folder or root, allow_not_found=True, recursive=deep))

    def partitions(self) -> list[InputPartition]:
        """The folder itself and, if asked to go deep, each of its sub-folders."""
        if not self.deep:
            return [_Part("", False)]
        below = [f.path for f in self._found(None, False)[2] if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]
        return [_Part("", False), *[_Part(path, True) for path in below]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, scheme, found = self._found(partition.folder, partition.deep)
        for file in found:
            hidden = any(name.startswith(("_", ".")) for name in file.path.removeprefix(partition.folder).split("/")[-1 if not partition.folder else 0:])
            if file.type != fs.FileType.File or hidden or not fnmatchcase(file.base_name, self.pattern):
                continue
            columns = None
            if self.header and file.size:
                with store.open_input_stream(file.path) as stream, io.TextIOWrapper(stream, "utf-8-sig", "replace", newline="") as text:
                    columns = next(csv.reader(text), [])
            yield scheme + file.path, file.size, columns


class FolderListing(DataSource):
    """Rows (``path``, ``length``, ``columns``) of the files of a folder, empty ones too; hidden ones are left out.

    Options: ``path``, ``pattern`` (of file names), ``deep`` (sub-folders too, a partition each), ``header`` (``columns``
    are the fields of a file's first CSV record, without a byte-order mark; NULL for an empty file).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, length bigint, columns array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def list_files(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False, header: bool = False) -> DataFrame:
    """Files of a folder with their sizes, empty ones too (which the file sources leave out); a missing folder has none."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").options(path=folder, pattern=pattern, deep=deep, header=header).load()
