"""Folders of office files as a Spark data source: spark.read.format("paperloom_office").load(folder).

A folder is listed once, when the scan is planned. Filters on extension and length thin the list before a file is
opened; what is left is dealt into partitions of about the same number of bytes. Any file system that
Arrow can open by URI will do, local paths included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from paperloom.sources import files

NAME = "paperloom_office"
#: Bytes of files in a partition, about; a larger file is a partition of its own.
PARTITION_BYTES = 64 << 20
#: Files that a partition hands on at a time, if their texts aren't long.
BATCH_FILES = 64

_SCHEMA = pa.schema([("path", pa.string()), ("filename", pa.string()), ("ext", pa.string()), ("file_size", pa.int64()), ("text", pa.string()), ("page_count", pa.int32()), ("error", pa.string())])

_COMPARED = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class OfficeFiles(InputPartition):
    """Files of one partition: (path, name, extension, size)."""

    files: tuple[tuple[str, str, str, int], ...]

    def __init__(self, given: tuple):
        super().__init__(None)
        self.files = given


def extension_of(name: str) -> str:
    """The last extension with its dot, lower case; none for a name that only begins with a dot."""
    head, dot, tail = name.rpartition(".")
    return f".{tail.lower()}" if dot and head else ""


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))
        self.extract = options.get("text", "true").lower() != "false"
        self.filters: list[tuple[type, str, object]] = []
        self.extractors = dict(files._EXTRACTORS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("ext",), ("file_size",)):
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def _wanted(self, ext: str, size: int) -> bool:
        return all(_COMPARED[kind]({"ext": ext, "file_size": size}[column], value) for kind, column, value in self.filters)

    def partitions(self) -> list[OfficeFiles]:
        system, folder = fs.FileSystem.from_uri(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File]
        told = [(i.path, i.base_name, extension_of(i.base_name), int(i.size)) for i in found if _wanted_name(i.base_name)]
        out, held, size = [], [], 0
        for one in sorted(f for f in told if self._wanted(f[2], f[3])):
            if held and size + one[3] > self.most:
                out.append(OfficeFiles(tuple(held)))
                held, size = [], 0
            held.append(one)
            size += one[3]
        return [*out, OfficeFiles(tuple(held))]

    def _text(self, system: fs.FileSystem, path: str, ext: str) -> tuple[str | None, int | None, str | None]:
        """(text, page_count, error); one file's failure stays its own."""
        if not self.extract:
            return None, None, None
        try:
            if ext not in self.extractors:
                raise ValueError(f"no extractor for {ext}")
            with system.open_input_file(path) as file:
                said = self.extractors[ext](file.read())
            return said.text.strip(), said.page_count, None
        except Exception as error:  # any extractor's error becomes the file's reject reason
            return None, None, f"{type(error).__name__}: {error}"

    def read(self, partition: OfficeFiles) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        told = ((*one, *self._text(system, one[0], one[2])) for one in partition.files)
        for rows in files.by_length(told, _SCHEMA.get_field_index("text"), BATCH_FILES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _wanted_name(name: str) -> bool:
    """Not what Hadoop's file systems leave beside files."""
    return not name.startswith(("_", ".")) and not name.endswith(".crc")


class OfficeSource(DataSource):
    """Rows (path, filename, ext, file_size, text, page_count, error), a file each, right in a folder.

    Options: partitionBytes; text=false lists without opening a file. Empty files are rows like others, with an error.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return from_arrow_schema(_SCHEMA)

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeSource)
