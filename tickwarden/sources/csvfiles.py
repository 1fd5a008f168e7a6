"""CSV files as a data source that tells what is wrong with them instead of failing.

One partition for each file, read record by record, so that a file of any length takes little memory. Rows have the file's
``path``, the number of the record in its file (the first one after the header is 2; a record with quoted line breaks is one), the required columns as text and ``issue_field``
and ``issue_message``. A file that is missing or whose header lacks columns is one row with an issue and no number; a record with more cells than the
header is a row with an issue. Other rows have no issue. Short records have nulls; empty lines are no records. As a stream, the files of a folder come in the order of their names.

Paths are those that Python's ``open`` or pyarrow's file systems reach on the executors.
"""

from __future__ import annotations

import csv
import io
import json
import os
import sys
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROWS = 10_000
FACTS = (("path", pa.string()), ("row_number", pa.int64()), ("issue_field", pa.string()), ("issue_message", pa.string()))


def _where(path: str) -> tuple[pafs.FileSystem, str]:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), os.path.abspath(parts.path if parts.scheme else path)
    return pafs.FileSystem.from_uri(path)


class OneFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def records(path: str, required: list[str]) -> Iterator[tuple]:
    """(row_number, issue_field, issue_message, *cells) of a file."""
    none = (None,) * len(required)
    system, name = _where(path)
    if system.get_file_info(name).type != pafs.FileType.File:
        yield (None, "csv_path", f"CSV file not found: {path}", *none)
        return
    with system.open_input_stream(name) as raw, io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8-sig", newline="") as text:
        reader = csv.reader(text)
        header = next(reader, [])
        if missing := [c for c in required if c not in header]:
            yield (None, "header", f"Missing required CSV columns: {', '.join(missing)}", *none)
            return
        at = [len(header) - 1 - header[::-1].index(c) for c in required]  # of columns with one name the last counts
        number = 1
        for cells in reader:
            if not cells:
                continue
            number += 1
            said = (None, None) if len(cells) <= len(header) else ("row", f"Unexpected extra CSV columns in {path} row {number}: {cells[len(header) :]}")
            yield (number, *said, *(cells[i] if i < len(cells) else None for i in at))


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        self.required = json.loads(options["required"])

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*FACTS, *((c, pa.string()) for c in self.required)])
        some: list[tuple] = []
        for r in records(partition.path, self.required):
            some.append((partition.path, *r))
            if len(some) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


class FilesReader(_Reading, DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.paths = json.loads(options["paths"])

    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for p in self.paths]


class FolderReader(_Reading, DataSourceStreamReader):
    """The files of a folder by name; the offset is the name of the last one read, so files must come with growing names."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.folder = options["folder"].rstrip("/")

    def _names(self) -> list[str]:
        system, name = _where(self.folder)
        return sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(name, allow_not_found=True)) if f.base_name.endswith(".csv"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"name": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        return [OneFile(f"{self.folder}/{n}") for n in self._names() if start["name"] < n <= end["name"]]

    def commit(self, end: dict) -> None:
        pass


class CheckedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checked_csv"

    def schema(self) -> str:
        columns = ", ".join(f"`{c}` string" for c in json.loads(self.options["required"]))
        return f"path string, row_number bigint, issue_field string, issue_message string, {columns}"

    def reader(self, schema) -> FilesReader:
        return FilesReader(dict(self.options))

    def streamReader(self, schema) -> FolderReader:  # noqa: N802
        return FolderReader(dict(self.options))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def csv_files(spark: SparkSession, paths: list[str], required: tuple[str, ...]) -> DataFrame:
    """All records of the files, and what is wrong with them."""
    spark.dataSource.register(CheckedCsv)
    return spark.read.format("checked_csv").option("paths", json.dumps(paths)).option("required", json.dumps(required)).load()


def csv_stream(spark: SparkSession, folder: str, required: tuple[str, ...]) -> DataFrame:
    """The same for the files that come into a folder."""
    spark.dataSource.register(CheckedCsv)
    return spark.readStream.format("checked_csv").option("folder", folder).option("required", json.dumps(required)).load()
