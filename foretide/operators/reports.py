"""Operations reports over logs and stores: alerts, journals, counters, health, status; and other forms of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.config import CONFIDENCE


def recent_alerts(alerts: DataFrame, level: str | None = None, limit: int = 50) -> DataFrame:
    """The last alerts, of one level if given."""
    held = alerts.filter(F.col("level") == level) if level else alerts
    return held.orderBy(F.desc("id")).limit(limit)


def journal_entries(log: DataFrame, since: str | None = None, **equal: object) -> DataFrame:
    """Entries of a journal by any of its columns, from an instant on (F22, F03); the filters reach the scan."""
    for name, value in equal.items():
        if value is not None:
            log = log.filter(F.col(name) == F.lit(value))
    return log.filter(F.col("at") >= F.lit(since).cast("timestamp_ntz")) if since else log


def last_entries(log: DataFrame, key: str, n: int) -> DataFrame:
    """The last n entries of each key."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id")))
    return log.withColumn("nth", newest).filter(F.col("nth") <= n)


def counters(log: DataFrame, name: Column, amount: Column, seconds: Column) -> DataFrame:
    """total, entries and mean duration of each counter (A31, Z08), over the log of what was counted."""
    return log.groupBy(name.alias("name")).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("entries"), F.round(F.avg(seconds), 4).alias("mean_seconds"))


def data_health(cycles: DataFrame) -> DataFrame:
    """One row: ok after a last finished cycle without errors, degraded after any other, unknown if none has finished.

    Columns cycle_id, status, started_at, finished_at. Also the last cycle that succeeded.
    """
    done = F.col("finished_at").isNotNull()
    at = F.struct("finished_at", "cycle_id")
    row = cycles.agg(
        F.max_by("status", F.when(done, at)).alias("last"), F.max_by("cycle_id", F.when(done & (F.col("status") == "DONE"), at)).alias("last_successful"), F.count(F.lit(1)).alias("cycles"),
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
    )
    health = F.when(F.col("last").isNull(), "unknown").when(F.col("last") == "DONE", "ok").otherwise("degraded")
    return row.select(health.alias("health"), "last_successful", "cycles", "matches", "requests")


def status_report(cycles: DataFrame, tables: dict[str, DataFrame], errors: DataFrame) -> DataFrame:
    """section, item, value (text) of all there is to say about the store (M18): health, rows of each table, errors of each source.

    Each part is an aggregate of its own; nothing is joined. errors: source, status.
    """
    health = data_health(cycles)
    parts = health.select(F.lit("cycles").alias("section"), F.explode(F.map_from_arrays(F.array(*map(F.lit, health.columns)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in health.columns]))).alias("item", "value"))
    for name, rows in tables.items():
        parts = parts.unionByName(rows.agg(F.lit("rows").alias("section"), F.lit(name).alias("item"), F.count(F.lit(1)).cast("string").alias("value")))
    by_source = errors.groupBy("source").agg(F.count_if(F.col("status") == "ERROR").alias("n"))
    return parts.unionByName(by_source.select(F.lit("errors").alias("section"), F.col("source").alias("item"), F.col("n").cast("string").alias("value")))


def registry_faults(sources: DataFrame, statuses: list[str], required: list[str]) -> DataFrame:
    """What is wrong with each entry of a registry (U08): statuses it doesn't list, fields it lacks, an id that comes twice.
    Columns source_id, statuses (array), and the required ones."""
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, statuses)), F.coalesce("statuses", F.array().cast("array<string>"))))
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    twice = F.count(F.lit(1)).over(Window.partitionBy("source_id")) > 1
    faults = F.concat(F.transform(lacking, lambda x: F.concat(F.lit("STATUS_"), x)), F.transform(empty, lambda x: F.concat(F.lit("MISSING_"), x)), F.array_compact(F.array(F.when(twice, "DUPLICATE"))))
    return sources.withColumn("faults", faults).filter(F.size("faults") > 0)


def provenance(points: DataFrame, as_of: str) -> DataFrame:
    """The contract's form of observations (M14): confidence as a number, the time of retrieval where none of effect is known,
    an age of 0 where it is unknown. What is projected is not changed."""
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("confidence")), F.lit(0.0))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("retrieved_at").cast("timestamp"))
    return points.select("point_id", "value", "data_type", "source", "retrieved_at", F.coalesce("effective_at", "retrieved_at").alias("effective_at"), number.alias("confidence"), F.coalesce(F.greatest(age, F.lit(0)), F.lit(0)).alias("freshness_sec"))


def points_by_type(points: DataFrame, key: str, last: int = 5) -> DataFrame:
    """A map from each type to its latest points of a key, oldest first (A29, Z11). The number in a list is bounded before it is gathered."""
    newest = F.row_number().over(Window.partitionBy(key, "data_type").orderBy(F.desc("retrieved_at"), F.desc("point_id")))
    held = points.withColumn("nth", newest).filter(F.col("nth") <= last)
    lists = held.groupBy(key, "data_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("retrieved_at", "point_id"))), lambda x: x["point_id"]).alias("ids"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("data_type", "ids")))).alias("by_type"))


def form_points(form: DataFrame, teams: DataFrame, n: int, fields: list[str]) -> DataFrame:
    """A team's form as an AGGREGATED observation, or an UNKNOWN one that says why (Z02). Columns team_id and fields."""
    rows = teams.select("team_id").join(form.select("team_id", F.to_json(F.struct(*fields)).alias("value"), F.lit(True).alias("known")), "team_id", "left")
    unknown = F.col("known").isNull()
    issues = F.when(unknown, F.array(F.lit("NO_COMPLETED_MATCHES_IN_WINDOW"))).otherwise(F.array().cast("array<string>"))
    return rows.select("team_id", F.lit(f"form_last_{n}").alias("data_type"), F.when(unknown, "UNKNOWN").otherwise("AGGREGATED").alias("level"), "value", unknown.alias("is_unknown"), issues.alias("issues"))


def decoded(rows: DataFrame, schema: str, column: str = "value_json") -> DataFrame:
    """Stored observations with their JSON as values again; what can't be read is null and unknown."""
    value = F.from_json(F.col(column), schema)
    return rows.withColumn("value", value).withColumn("is_unknown", F.col("is_unknown") | value.isNull()).drop(column)


def of_tier(jobs: DataFrame, tier: str) -> DataFrame:
    """The calendar's tier takes all jobs, any other those of its phase."""
    return jobs if tier == "calendar" else jobs.filter(F.col("phase") == tier)


def identity_decisions(points: DataFrame) -> DataFrame:
    """Of each match the first observation that holds a decision on its identity."""
    held = points.filter("data_type = 'identity_decision'")
    return held.groupBy("match_id").agg(F.min_by("value", F.struct("retrieved_at", "point_id")).alias("decision"))


def cache_entries(entries: DataFrame, at: str) -> DataFrame:
    """key_hash, source and whether an entry is alive at an instant."""
    alive = F.col("expires_at") > F.lit(at).cast("timestamp_ntz")
    return entries.select(F.substring(F.sha2(F.concat_ws("|", "source", "url"), 256), 1, 16).alias("key_hash"), "source", F.coalesce(alive, F.lit(True)).alias("alive"))
