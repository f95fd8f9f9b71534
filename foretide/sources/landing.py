"""Landing files as a source of Spark: spark.read.format("landing").

A landing folder holds files of JSON lines below source=<name>/, one observation each: a key, a type, a value, and when it was
retrieved. A partition of the source is a run of whole files of about `bytes` bytes, so a scan is as parallel as its files allow.
Filters on the source choose folders before any file is opened, and filters on the type are applied while lines are read;
only columns of the schema are made. Files are reached through Arrow's file systems, so a folder can be local or remote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "source string, key string, data_type string, value string, retrieved_at string"
_FIELDS = ("key", "data_type", "value", "retrieved_at")
_ARROW = pa.schema([(name, pa.string()) for name in ("source", *_FIELDS)])
_ROWS = 8192


@dataclass
class Files(InputPartition):
    """source and path of each file."""

    held: list[tuple[str, str]]


class LandingSource(DataSource):
    """Options: path; bytes, of the files of a partition (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LandingReader(self.options)


class LandingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bytes = options["path"], int(options.get("bytes", 1 << 26))
        self.sources: set[str] | None = None
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("source",), ("data_type",)):
                yield f  # left to Spark
            elif f.attribute == ("source",):
                self.sources = values if self.sources is None else self.sources & values
            else:
                self.types = values if self.types is None else self.types & values

    def partitions(self) -> list[Files]:
        files, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        out, size = [Files([])], 0
        for info in sorted(files.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            folders = [p for p in info.path[len(root) :].split("/")[:-1] if p.startswith("source=")]
            named = info.base_name
            if info.type != fs.FileType.File or named[0] in "._" or not folders:
                continue
            source = folders[-1].removeprefix("source=")
            if self.sources is not None and source not in self.sources:
                continue
            if out[-1].held and size + info.size > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].held.append((source, info.path))
            size += info.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.path)[0] if ":/" in self.path else fs.LocalFileSystem()
        rows: list[tuple] = []
        for source, path in partition.held:
            with files.open_input_stream(path, compression="detect") as stream, pa.PythonFile(stream, "r") as lines:
                for line in _lines(lines):
                    row = _row(source, line)
                    if row is None or (self.types is not None and row[2] not in self.types):
                        continue
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    yield rest


def _row(source: str, line: bytes) -> tuple | None:
    """None for a line that is empty or no object: a broken line loses nothing but itself."""
    try:
        held = json.loads(line)
    except ValueError:
        return None
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return (source, *(text(held.get(c)) for c in _FIELDS)) if isinstance(held, dict) else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_ARROW)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The observations of a landing folder."""
    spark.dataSource.register(LandingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landing").option("path", path).load()


def land(points: DataFrame, path: str) -> None:
    """Writes observations (source, key, data_type, value, retrieved_at) where landed() reads them."""
    line = F.to_json(F.struct(*_FIELDS)).alias("value")
    points.select("source", line).write.mode("append").partitionBy("source").option("compression", "gzip").text(path)
