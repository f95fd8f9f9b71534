"""Several tables written as one: staged files, and a manifest whose name is the transaction.

A transaction writes the rows of each table into a folder of its own, which no reader looks at. Then one small file that names
these folders is put in its place by a rename that never replaces another one: from then on all of its rows are there, before it
none. A name that has been committed is not committed again, so a batch that comes twice, or a job that two drivers run, counts
once. Readers take the folders that manifests name and nothing else. The folder must be on a file system whose
renames are atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "transaction string, position long, written_at string, table string, folder string"


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """transaction, position, written_at, table, folder: one row for each table of each committed transaction."""
    if not _files(spark, root).exists(_path(spark, f"{root}/manifests")):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{root}/manifests")


def committed(spark: SparkSession, root: str, transaction: str) -> bool:
    return _files(spark, root).exists(_path(spark, f"{root}/manifests/{transaction}.json"))


def commit(spark: SparkSession, root: str, transaction: str, tables: dict[str, DataFrame], position: int = 0, written_at: str = "") -> bool:
    """Writes all tables or none (S18, S22); whether this call was the one that did. The name holds letters, digits, - and _."""
    if not transaction or not all(c.isalnum() or c in "-_" for c in transaction) or transaction[0] == "_":
        raise ValueError(f"not a name of a transaction: {transaction!r}")
    if committed(spark, root, transaction):
        return False
    attempt, lines = uuid.uuid4().hex, []
    for name, rows in tables.items():
        folder = f"data/{name}/{transaction}-{attempt}"
        rows.write.parquet(f"{root}/{folder}")
        lines.append(json.dumps({"transaction": transaction, "position": position, "written_at": written_at, "table": name, "folder": folder}))
    files = _files(spark, root)
    staged, place = _path(spark, f"{root}/manifests/_{attempt}"), _path(spark, f"{root}/manifests/{transaction}.json")
    out = files.create(staged, False)
    out.write("\n".join(lines).encode())
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(staged, place, none)
    except Exception as refused:
        if "FileAlreadyExistsException" not in str(refused):
            raise
        files.delete(staged, False)
        return False  # another one was first
    return True


def read(spark: SparkSession, root: str, table: str, schema: StructType | str, with_transaction: bool = False) -> DataFrame:
    """The rows of a table that are committed; with the name of their transaction if asked for. Without any, no rows. The driver gets one
    path for each commit of the table."""
    folders = [f"{root}/{r.folder}" for r in manifests(spark, root).filter(F.col("table") == table).select("folder").collect()]
    rows = spark.read.schema(schema)
    out = rows.parquet(*folders) if folders else spark.createDataFrame([], schema)
    if not with_transaction:
        return out
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)-[0-9a-f]{32}/[^/]*$", 1) if folders else F.lit(None).cast("string")
    return out.select("*", name.alias("transaction"))


def forgotten(spark: SparkSession, root: str) -> list[str]:
    """Removes folders that no manifest names, left by transactions that failed, and tells which. Nothing may be writing."""
    files, kept = _files(spark, root), {r.folder for r in manifests(spark, root).select("folder").collect()}
    gone = []
    for table in files.listStatus(_path(spark, f"{root}/data")) if files.exists(_path(spark, f"{root}/data")) else []:
        for folder in files.listStatus(table.getPath()):
            name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
            if name not in kept:
                files.delete(folder.getPath(), True)
                gone.append(name)
    return sorted(gone)


def in_transactions(root: str, name: str, made: Callable[[DataFrame, int], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is one transaction over the tables made of it, and a batch that comes again changes nothing (T-14)."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if committed(spark, root, f"{name}-{number}"):
            return
        batch.persist()
        try:
            commit(spark, root, f"{name}-{number}", made(batch, number), number)
        finally:
            batch.unpersist()

    return run


def to_recover(cycles: DataFrame, at: str, seconds: int, times: int = 4) -> DataFrame:
    """name, last_cycle, unfinished, idle_seconds of what must be started anew (T-13): its last finished cycle is older than `times` of its
    interval, or none has finished. Columns name, cycle, started_at, finished_at (null while it runs, or if it broke off); what
    starts or ends after `at` is not known yet."""
    now = F.lit(at).cast("timestamp_ntz")
    known = cycles.filter(F.col("started_at") <= now)
    done = F.col("finished_at") <= now
    last = known.groupBy("name").agg(F.max(F.when(done, F.struct("finished_at", "cycle"))).alias("last"), F.count_if(~F.coalesce(done, F.lit(False))).alias("unfinished"))
    idle = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last.finished_at").cast("timestamp"))
    out = last.select("name", F.col("last.cycle").alias("last_cycle"), "unfinished", idle.alias("idle_seconds"))
    return out.filter(F.col("idle_seconds").isNull() | (F.col("idle_seconds") > times * seconds))
