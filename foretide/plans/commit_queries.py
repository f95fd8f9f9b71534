"""Queries of what is written in transactions, sinks and recovery, and of versions known at an instant; with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.operators import intervals
from foretide.plans.views import OBSERVATIONS_SQL, OBSERVED_AT, observations, table
from foretide.sources import sinks, transactions
from foretide.streaming import pipelines
from foretide.streaming.scratch import shared_folder


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


_PURCHASES, _TOTALS = "event_id long, user_id long, value double", "event_type string, n long, total double"


def made_of_batch(batch: DataFrame, _: int) -> dict[str, DataFrame]:
    """The tables of a batch of events: purchases, and totals by type."""
    purchases = batch.filter("event_type = 'purchase'").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "value")
    totals = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return {"purchases": purchases, "totals": totals}


def committed_tables(spark: SparkSession, root: str) -> DataFrame:
    """Of each type: purchases that are committed, and what the totals of the same transactions say."""
    bought = transactions.read(spark, root, "purchases", _PURCHASES).agg(F.count(F.lit(1)).alias("rows")).withColumn("event_type", F.lit("purchase"))
    said = transactions.read(spark, root, "totals", _TOTALS).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))
    return said.join(bought, "event_type", "left").select("event_type", "n", "total", F.coalesce("rows", F.lit(0)).alias("purchases"))


def stream_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose batches are transactions over two tables, read again (S18, S22, T-14)."""
    root, path = _folder(spark, "transactions"), f"{sf_dir}/events.parquet"
    stream = pipelines.source(spark, path, spark.read.parquet(path).schema)
    pipelines.run_batches(stream, transactions.in_transactions(root, "events", made_of_batch), f"{root}/checkpoint", "append")
    return committed_tables(spark, root)


def recovery_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' cycles: some broke off; whose last finished one is older than four of its intervals starts anew (T-13)."""
    ended = F.when(F.col("event_id") % 9 != 0, F.expr("ts + make_dt_interval(0, 0, CAST(event_id % 50 AS INT))"))
    cycles = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("cycle"), F.col("ts").alias("started_at"), ended.alias("finished_at"))
    return transactions.to_recover(cycles, OBSERVED_AT, 10_800).withColumnRenamed("name", "user_id")


def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each key of an appended table, whose backup is read."""
    root, rows = _folder(spark, "sinks"), table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    for half in (0, 1):
        sinks.append(rows.filter(F.col("event_id") % 2 == half), f"{root}/state")
    sinks.backup(spark, f"{root}/state", f"{root}/backup")
    return sinks.current(spark, f"{root}/backup", ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def feed_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a compressed feed of one document a day, read again."""
    root = _folder(spark, "feed")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    rows = table(spark, sf_dir, "orders").select(day, F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("league"))
    sinks.feed(rows, ["day"], ["league", "id"], root)
    back = sinks.read_feed(spark, root, "day string, rows array<struct<league:string,id:long>>")
    return back.select("day", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["id"].alias("first_id"), F.size(F.array_distinct("rows.league")).cast("long").alias("leagues"))


def versions_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each match and type when each of its purchases was made."""
    points = observations(spark, sf_dir).select("match_id", "data_type", "point_id", "retrieved_at", "effective_at")
    probes = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("match_id"), F.lit("view").alias("data_type"), F.col("event_id").alias("probe_id"), F.col("ts").alias("as_of"))
    return intervals.known_at(probes, points, ["match_id", "data_type"]).select("probe_id", "point_id")


QUERIES = {f.__name__: f for f in (stream_transactions, recovery_due, state_latest, feed_of_days, versions_known)}
ORACLES = {
    "stream_transactions": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1",
    "recovery_due": f"""WITH c AS (SELECT user_id, event_id AS cycle, ts AS s, CASE WHEN event_id % 9 <> 0 THEN ts + to_minutes(CAST(event_id % 50 AS INTEGER)) END AS f FROM events WHERE ts <= TIMESTAMP '{OBSERVED_AT}'),
g AS (SELECT user_id, max(row(f, cycle)) FILTER (WHERE f <= TIMESTAMP '{OBSERVED_AT}') AS last, count(*) FILTER (WHERE f IS NULL OR f > TIMESTAMP '{OBSERVED_AT}') AS unfinished FROM c GROUP BY 1),
i AS (SELECT user_id, last[2] AS last_cycle, unfinished, CAST(floor(epoch(TIMESTAMP '{OBSERVED_AT}')) - floor(epoch(last[1])) AS BIGINT) AS idle_seconds FROM g)
SELECT * FROM i WHERE idle_seconds IS NULL OR idle_seconds > 43200""",
    "state_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "feed_of_days": "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS id, o_orderpriority AS league FROM orders) SELECT day, count(*) AS n, arg_min(id, row(league, id)) AS first_id, count(DISTINCT league) AS leagues FROM o GROUP BY 1",
    "versions_known": f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT event_id AS probe_id, user_id AS match_id, ts AS as_of FROM events WHERE event_type = 'purchase'),
m AS (SELECT probe_id, point_id, as_of, effective_at, retrieved_at, max(retrieved_at) OVER (PARTITION BY probe_id) AS last FROM p JOIN observations USING (match_id) WHERE data_type = 'view' AND retrieved_at <= as_of)
SELECT probe_id, point_id FROM m WHERE retrieved_at = last AND (effective_at IS NULL OR effective_at <= as_of)""",
}
