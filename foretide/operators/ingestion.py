"""Ingestion: budgets, fallbacks, alerts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_windows(requests: DataFrame, most: int = 20, seconds: int = 25, apart: int = 1) -> DataFrame:
    """Requests of each tumbling window of a source, those over its budget, and those that came too soon (T-10).

    Gaps are taken within a window; only the ends of windows, one row each, are put in order over the whole time of a source.
    """
    start = (F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / seconds) * seconds).cast("long")
    rows, step = requests.withColumn("window_start", start), F.expr(f"INTERVAL {apart} SECONDS")
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("source", "window_start").orderBy("at", "request_id"))
    out = rows.withColumn("soon", gap < step).groupBy("source", "window_start").agg(F.count(F.lit(1)).alias("n"), F.count_if("soon").alias("soon"), F.min("at").alias("first"), F.max("at").alias("last"))
    before = F.lag("last").over(Window.partitionBy("source").orderBy("window_start"))
    too_soon = F.col("soon") + F.coalesce((F.col("first") - before < step).cast("long"), F.lit(0))
    return out.withColumn("too_soon", too_soon).select("source", "window_start", "n", "too_soon", F.greatest(F.col("n") - most, F.lit(0)).alias("over_budget"))


def cycle_cap(jobs: DataFrame, cycle: str, order: list[str], cost: str, cap: int = 20) -> DataFrame:
    """Jobs of a cycle in order, until what went before reaches the cap (K11, K10). The first of order is an instant: sums run
    within its hour, and over the hours of a cycle, so that a large cycle is many tasks."""
    hour = F.date_trunc("hour", order[0])
    rows = jobs.withColumn("hour", hour)
    within = Window.partitionBy(cycle, "hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(cycle).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy(cycle, "hour").agg(F.sum(cost).alias("spent")).withColumn("spent", F.coalesce(F.sum("spent").over(earlier), F.lit(0)))
    before = F.col("spent") + F.coalesce(F.sum(cost).over(within), F.lit(0))
    out = rows.join(hours, [cycle, "hour"]).withColumn("before", before).drop("hour", "spent")
    return out.withColumn("state", F.when(F.col("before") < cap, "RUN").otherwise("CYCLE_CAP"))


def first_working(results: DataFrame, chain: DataFrame, *key: str) -> DataFrame:
    """The best-ranked source that worked for each key, and how many before it had not (T-15)."""
    ranked = results.join(chain, "source")
    best = F.min(F.when(F.col("ok"), F.struct("rank", "source")))
    return ranked.groupBy(*key).agg(best.alias("best"), F.count_if(~F.col("ok")).alias("failed")).select(*key, F.col("best.source").alias("source"), "failed")


def cycle_statistics(cycles: DataFrame, *by: str) -> DataFrame:
    """Requests a match, and the share of failures."""
    return cycles.groupBy(*by).agg(
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.round(F.try_divide(F.sum("requests"), F.sum("matches")), 2).alias("per_match"),
        F.round(100 * F.try_divide(F.count_if("failed"), F.count(F.lit(1))), 1).alias("failure_pct"),
    )


def alerts(per_match: Column, failure_pct: Column, unknown_pct: Column) -> Column:
    """Codes of the thresholds that are passed."""
    rules = [F.when(per_match > 20, "ERROR_REQUESTS").when(per_match > 8, "WARN_REQUESTS"), F.when(failure_pct > 50, "FAILURES"), F.when(unknown_pct > 30, "IDENTITY_UNKNOWN")]
    return F.array_compact(F.array(*rules))


def due(runs: DataFrame, key: str, seconds: int) -> DataFrame:
    """Runs that began when they were due: `seconds` after the one before, or first (T-12)."""
    gap = F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.lag("at").over(Window.partitionBy(key).orderBy("at", "run_id")).cast("timestamp"))
    return runs.withColumn("gap", gap).withColumn("due", F.col("gap").isNull() | (F.col("gap") >= seconds))


def journal(rows: DataFrame, forbidden: Iterator[str] | list[str]) -> DataFrame:
    """Details of a journal without keys that must not be kept."""
    return rows.withColumn("detail", F.map_filter("detail", lambda k, _: ~F.lower(k).isin(*forbidden)))
