"""Domain tables over the star schema: fixtures, observations, and frozen forecasts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixtures before this day are history, those from it on are to be forecast.
FORECAST_DAY = "2001-06-01"
#: The instant at which all fixtures are over.
AFTER_ALL = "2001-08-02"
#: An instant within the observations.
OBSERVED_AT = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: sides from the customer, goals from its odd and even lines. Lines are summed before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.count_if(F.col("l_linenumber") % 2 == 1).alias("hg"), F.count_if(F.col("l_linenumber") % 2 == 0).alias("ag")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderpriority").alias("competition"), (F.col("o_custkey") % 20).alias("home_id"),
        ((F.col("o_custkey") % 20 + 1 + F.col("o_orderkey") % 19) % 20).alias("away_id"), F.col("o_orderdate").alias("kickoff"), F.col("o_orderstatus").alias("src_status"),
    )
    return orders.join(lines, "match_id", "left").withColumns({"hg": F.coalesce("hg", F.lit(0)).cast("long"), "ag": F.coalesce("ag", F.lit(0)).cast("long")})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as datapoints with two times; every eleventh value is unknown."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("point_id"), F.col("user_id").alias("match_id"), F.col("event_type").alias("data_type"),
        F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"), F.col("ts").alias("retrieved_at"),
        F.when(e % 5 != 0, F.expr("ts + make_dt_interval(0, CAST(event_id % 7 AS INT) - 3, 0, 0)")).alias("effective_at"),
        F.when(e % 11 != 0, F.col("value")).alias("value"), (e % 11 == 0).alias("is_unknown"),
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "unknown"))), (e % 4 + 1).cast("int")).alias("confidence"),
    )


_KEPT: list[DataFrame] = []


def reused(rows: DataFrame) -> DataFrame:
    """rows that several steps of one query read, computed once and kept with the executors, in memory or on disk. What the query before
    kept is let go; if it is still to be read, or an executor is lost, it is computed anew."""
    while _KEPT:
        old = _KEPT.pop()
        if old.sparkSession is rows.sparkSession:
            old.unpersist()
    _KEPT.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


#: The same tables for DuckDB.
FIXTURES_SQL = """fixtures AS (
  SELECT o_orderkey AS match_id, o_orderpriority AS competition, o_custkey % 20 AS home_id,
         (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away_id, o_orderdate AS kickoff, o_orderstatus AS src_status,
         count(l_orderkey) FILTER (WHERE l_linenumber % 2 = 1) AS hg, count(l_orderkey) FILTER (WHERE l_linenumber % 2 = 0) AS ag
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderpriority, o_custkey, o_orderdate, o_orderstatus)"""

OBSERVATIONS_SQL = """observations AS (
  SELECT event_id AS point_id, user_id AS match_id, event_type AS data_type, 's' || (event_id % 3) AS source, ts AS retrieved_at,
         CASE WHEN event_id % 5 <> 0 THEN ts + to_hours(CAST(event_id % 7 AS INTEGER) - 3) END AS effective_at,
         CASE WHEN event_id % 11 <> 0 THEN value END AS value, event_id % 11 = 0 AS is_unknown,
         ['high', 'medium', 'low', 'unknown'][event_id % 4 + 1] AS confidence
  FROM events)"""
