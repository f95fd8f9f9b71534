"""Writing: appends, latest-wins tables, and backups. A write is one atomic commit of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.operators.ledger import latest


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Rows are added; what lies there is never rewritten."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path) if partition_by else rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    """S20 on a folder: keys that are there already, or come twice, are not added."""
    from foretide.operators.ledger import insert_once

    spark = rows.sparkSession
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = rows.limit(0)
    append(insert_once(stored, rows, key, order), path)


def current(spark: SparkSession, path: str, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key of an append-only table, instead of rewriting rows."""
    return latest(spark.read.parquet(path), key, order).drop("rank")


def backup(spark: SparkSession, path: str, to: str) -> int:
    """A copy of a table; the number of its rows."""
    rows = spark.read.parquet(path)
    rows.write.mode("overwrite").parquet(to)
    return spark.read.parquet(to).count()


def feed(rows: DataFrame, by: list[str], order: list[str], path: str) -> None:
    """One JSON document for each value of `by`, its rows in order, compressed; null fields are written as such."""
    inner = [c for c in rows.columns if c not in by]
    held = F.array_sort(F.collect_list(F.struct(*order, *[c for c in inner if c not in order])))
    documents = rows.groupBy(*by).agg(held.alias("rows"))
    documents.select(F.to_json(F.struct(*by, "rows"), {"ignoreNullFields": "false"}).alias("value")).write.option("compression", "gzip").text(path)


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of a feed, those that can't be read left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    return rows.filter(F.col("d").isNotNull()).select("d.*")
