"""What the corpus operators share: reading inputs, the shared scratch folder, and stage boundaries."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters and the white space of the contracts, [\x20\x09-\x0D].
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(name: str, divisor: int) -> Column:
    """crc32 of the decimal text of an id, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % divisor


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset, on a single machine (tests). On a cluster executors
    would not see each other's files in it, so this is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='foretide-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Small intermediate results: cut off from their lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """Large intermediate results: a compressed table in the shared folder, removed by remove_tables() or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foretide-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that materialised() has written and nothing has removed yet.
_TABLES: list[str] = []


def tables_so_far() -> list[str]:
    return list(_TABLES)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no result still to be computed reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _TABLES.remove(path)


def _as_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.concatenate(rows, axis=1).tobytes(), 1)], pa.binary())], ["data"])


def at_driver(df: DataFrame) -> Iterator[np.ndarray]:
    """A table of bounded size, of longs without nulls, at the driver: a task's rows at a time as (columns, rows), compressed on the way."""
    for row in df.mapInArrow(_as_one, "data binary").toLocalIterator():
        yield np.frombuffer(zlib.decompress(row.data), np.int64).reshape(len(df.columns), -1)
