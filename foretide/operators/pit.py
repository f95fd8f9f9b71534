"""The point-in-time store: two times for each observation, freshness, validation, conflicts, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.config import CONFIDENCE, QUALITY, TTL_SECONDS


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def usable_at(as_of: str | Column, strict: bool = False) -> Column:
    """Known and in effect at as_of, to the second (F05, T26); strict also wants a time of effect."""
    at = instant(as_of) if isinstance(as_of, str) else as_of
    known = F.date_trunc("second", "retrieved_at") <= at
    effect = F.date_trunc("second", "effective_at") <= at
    return known & (F.coalesce(effect, F.lit(False)) if strict else F.coalesce(effect, F.lit(True)))


def query(points: DataFrame, as_of: str | None = None, **equal: object) -> DataFrame:
    """Filters for the arguments that are given (F04, M02); each reaches the scan."""
    for name, value in equal.items():
        if value is not None:
            points = points.filter(F.col(name) == F.lit(value))
    return points.filter(usable_at(as_of)) if as_of else points


def latest_as_of(points: DataFrame, as_of: str, *key: str) -> DataFrame:
    """The latest usable observation of each key (J09, M03): the first of those retrieved last. One aggregate, without a sort."""
    rest = [c for c in points.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct("retrieved_at", -F.col("point_id")))
    return points.filter(usable_at(as_of)).groupBy(*key).agg(newest.alias("row")).select(*key, "row.*")


def asof_join(left: DataFrame, points: DataFrame, key: str, at: str, bucket: str = "day") -> DataFrame:
    """For each row of left the last observation of its key retrieved at `at` or before (J09 with an instant per row).

    Both sides meet by key and bucket of time in a running maximum, so no pair is ever built and a key with many rows is many
    tasks; the last observation of the buckets before, one row each, is carried on to those that follow. Rows of left keep
    their columns; `seen_at` and `seen_value` are null where nothing was known.
    """
    columns = left.columns
    none = F.lit(None)
    a = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.struct(*columns).alias("row"), none.cast("struct<t:timestamp_ntz,id:bigint,value:double>").alias("point"))
    b = points.select(F.col(key).alias("k"), F.col("retrieved_at").alias("t"), F.lit(0).alias("side"), none.cast(a.schema["row"].dataType).alias("row"), F.struct(F.col("retrieved_at").alias("t"), F.col("point_id").alias("id"), F.col("value").alias("value")).alias("point"))
    both = a.unionByName(b).withColumn("b", F.date_trunc(bucket, "t"))
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("k", "b").agg(F.max("point").alias("last")).withColumn("carried", F.max("last").over(earlier)).select(F.col("k").alias("of_k"), F.col("b").alias("of_b"), "carried")
    run = Window.partitionBy("k", "b").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("seen", F.max("point").over(run)).filter("side = 1")
    met = met.join(carried, met["k"].eqNullSafe(carried["of_k"]) & met["b"].eqNullSafe(carried["of_b"]), "left")
    seen = F.coalesce("seen", "carried")
    return met.select("row.*", seen["t"].alias("seen_at"), seen["value"].alias("seen_value"))


def dedupe_key(*columns: str) -> Column:
    """H04."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def exact_dedupe(points: DataFrame, *columns: str) -> DataFrame:
    """One of each set of equal observations, the first."""
    rest = [c for c in points.columns]
    return points.withColumn("dedupe_key", dedupe_key(*columns)).groupBy("dedupe_key").agg(F.min_by(F.struct(*rest), "point_id").alias("row"), F.count(F.lit(1)).alias("copies")).select("row.*", "dedupe_key", "copies")


def ttl_seconds(data_type: Column, overrides: dict[str, int] | None = None) -> Column:
    """Null if it never expires, -1 if unknown."""
    held = TTL_SECONDS | (overrides or {})
    out = F.when(F.lit(False), F.lit(0))
    for name, seconds in held.items():
        out = out.when(data_type == name, F.lit(seconds).cast("int"))
    return out.otherwise(F.lit(-1))


def age_seconds(as_of: str) -> Column:
    """D04."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return F.greatest(F.lit(0), seconds(instant(as_of)) - seconds(F.col("retrieved_at")))


def freshness(points: DataFrame, as_of: str, ttl: Column) -> DataFrame:
    """age and status: fresh, stale, no_expiry, ttl_unknown."""
    status = F.when(ttl == -1, "ttl_unknown").when(ttl.isNull(), "no_expiry").when(F.col("age") <= ttl, "fresh").otherwise("stale")
    return points.withColumn("age", age_seconds(as_of)).withColumn("freshness", status)


def usable_for_forecast(points: DataFrame, as_of: str, ttl: Column) -> DataFrame:
    """M08."""
    return freshness(points.filter(usable_at(as_of)), as_of, ttl).filter("freshness IN ('fresh', 'no_expiry')")


#: Bounds of a value by its type.
BOUNDS = {"score": (0, 99), "possession": (0, 100), "probability": (0, 1), "minute": (0, 130)}


def issues(data_type: Column, value: Column) -> Column:
    """Codes of the rules that a value breaks (M05, Z01); an unknown value breaks none."""
    rules = [F.when((data_type == t) & ~value.between(low, high), F.lit(f"{t}_out_of_range")) for t, (low, high) in BOUNDS.items()]
    rules += [F.when((data_type == "odd") & (value <= 1), F.lit("odd_too_small")), F.when((data_type == "count") & (value < 0), F.lit("negative_count"))]
    return F.when(value.isNotNull(), F.array_compact(F.array(*rules))).otherwise(F.array().cast("array<string>"))


def validated(points: DataFrame) -> DataFrame:
    """issues and valid; rows stay."""
    return points.withColumn("issues", issues(F.col("data_type"), F.col("value"))).withColumn("valid", F.size("issues") == 0)


def contract_violations(points: DataFrame, required: list[str]) -> Column:
    """What a row of provenance lacks."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    checks += [F.when(~F.col("confidence").between(0, 1), F.lit("confidence")), F.when(F.col("freshness_sec") < 0, F.lit("freshness"))]
    return F.array_compact(F.array(*checks))


def conflicts(points: DataFrame, *key: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys on which two sources or more differ."""
    known = points.filter("value IS NOT NULL")
    spread = known.groupBy(*key).agg(F.countDistinct("source").alias("sources"), F.min("value").alias("low"), F.max("value").alias("high"))
    return spread.filter((F.col("sources") > 1) & (F.col("high") - F.col("low") > tolerance))


def resolve_conflicts(points: DataFrame, priority: DataFrame, *key: str) -> DataFrame:
    """The value that counts: of the best source, then the latest, then the surest; else UNKNOWN (M11, W10, T16). Never a mean.

    One aggregate: the best rank is a maximum over (rank, time, confidence), and how many rows share it is counted beside it.
    priority: source, rank (1 is best); a small table.
    """
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("confidence"))
    rows = points.filter("value IS NOT NULL").join(priority, "source", "left").withColumn("sure", sure).withColumn("rank", -F.coalesce("rank", F.lit(9999)))
    best = rows.groupBy(*key).agg(F.max(F.struct("rank", "retrieved_at", "sure")).alias("best"), F.countDistinct("rank").alias("ranks"), F.countDistinct("retrieved_at").alias("times"))
    met = rows.join(best, list(key)).filter(F.struct("rank", "retrieved_at", "sure").eqNullSafe(F.col("best")))
    out = met.groupBy(*key).agg(F.count(F.lit(1)).alias("tied"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("ranks").alias("ranks"), F.first("times").alias("times"))
    decision = F.when(F.col("tied") > 1, "UNKNOWN_CRITICAL_CONFLICT").when(F.col("ranks") > 1, "PRIORITY_SOURCE").when(F.col("times") > 1, "RECENCY_TIEBREAK").otherwise("CONFIDENCE_TIEBREAK")
    return out.select(*key, decision.alias("decision"), F.when(F.col("tied") == 1, F.col("low")).alias("value"), (F.col("low") == F.col("high")).alias("values_agree"))


def quality_score(points: DataFrame, as_of: str, expected: list[str], ttl: Column, *key: str) -> DataFrame:
    """Five components, their weighted sum, and a grade."""
    seen = freshness(points.filter(usable_at(as_of) & F.col("value").isNotNull()), as_of, ttl)
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("confidence"))
    fresh = F.when(ttl == -1, 0.0).when(ttl.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("age") / ttl))
    by_type = seen.withColumns({"sure": sure, "fresh": fresh}).groupBy(*key, "data_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sure").alias("sure"), F.sum("fresh").alias("fresh"), F.countDistinct("source").alias("sources"), F.count_if(F.col("effective_at").isNotNull()).alias("timed")
    )
    n = F.sum("n")
    parts = by_type.groupBy(*key).agg(
        (F.sum("sure") / n).alias("reliability"), (F.sum("fresh") / n).alias("freshness"), F.avg((F.col("sources") > 1).cast("double")).alias("confirmation"), (F.sum("timed") / n).alias("temporal"),
        (F.count_if(F.col("data_type").isin(*expected)) / len(expected)).alias("completeness"),
    )
    score = sum((w * F.col(c) for c, w in QUALITY.items()), F.lit(0.0))
    scored = parts.withColumn("score", score)
    return scored.withColumn("grade", F.when(F.col("score") >= 0.85, "A").when(F.col("score") >= 0.70, "B").when(F.col("score") >= 0.50, "C").otherwise("D"))


def quality_rates(points: DataFrame, *by: str) -> DataFrame:
    """Shares of unknown, sure and timed observations (A23); null on an empty denominator."""
    share = lambda test: F.round(F.try_divide(F.count_if(test), F.count(F.lit(1))), 4)
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("is_unknown")).alias("unknown_rate"), share(F.col("confidence") == "high").alias("high_rate"), share(F.col("effective_at").isNotNull()).alias("timed_rate"))


def phase(minutes: Column) -> Column:
    """The phase of a game by the minutes to its start."""
    return F.when(minutes < -150, "POST").when(minutes < 0, "LIVE").when(minutes <= 15, "T-15").when(minutes <= 60, "T-60").when(minutes <= 180, "T-180").otherwise("HORIZON")


def snapshots(points: DataFrame, kickoffs: DataFrame, before: list[int]) -> DataFrame:
    """For each start and each lead in minutes the number and the types of what was usable, and the reason to refuse."""
    at = F.explode(F.array(*map(F.lit, before)))
    wanted = kickoffs.withColumn("lead", at).withColumn("as_of", F.col("kickoff") - F.make_dt_interval(mins=F.col("lead")))
    rows = wanted.join(points, "match_id", "left")
    usable = F.coalesce(usable_at(F.col("as_of")), F.lit(False)) & F.col("value").isNotNull()
    out = rows.groupBy("match_id", "lead", "as_of").agg(F.count_if(usable).alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(usable, F.col("data_type")))), ",").alias("types"))
    tier = F.when(F.size(F.split("types", ",")) >= 5, "high").when(F.size(F.split("types", ",")) >= 3, "medium").otherwise("low")
    return out.withColumn("reason", F.when(F.col("n") == 0, "NO_USABLE_DATA").otherwise("OK")).withColumn("tier", F.when(F.col("n") > 0, tier).otherwise("none"))


def compare_latest(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Latest rows of two pipelines side by side."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    state = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return both.withColumn("state", state)


def nearest_slot(targets: DataFrame, slots: DataFrame, key: str, most_minutes: int = 30) -> DataFrame:
    """The slot nearest to each target's instant, the earlier of two (J11, S11). Slots are hourly: a target can only be nearest to the
    hours around it, so the two meet in an equi-join on the hour. gap: whether it is further off than most_minutes."""
    hour = F.date_trunc("hour", "at")
    wanted = targets.withColumn("hour", F.explode(F.array(hour, hour + F.expr("INTERVAL 1 HOUR"))))
    met = wanted.join(slots.withColumnRenamed("slot", "hour"), [key, "hour"])
    off = F.abs(F.unix_seconds(F.col("hour").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")))
    best = met.withColumn("off", off).groupBy(*targets.columns).agg(F.min(F.struct("off", "hour", "value")).alias("best"))
    return best.select(*targets.columns, F.col("best.hour").alias("slot"), F.col("best.value").alias("value"), (F.col("best.off") > 60 * most_minutes).alias("gap"))


def priority_table(spark: SparkSession, chain: list[str]) -> DataFrame:
    """source, rank from a chain."""
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(chain)], "source string, rank int")


def corrupt_or_expired(cache: DataFrame, as_of: str) -> DataFrame:
    """What a cache must forget (M16, F10): body, checksum, expires_at."""
    state = F.when(F.sha2("body", 256) != F.col("checksum"), "corrupt").when(F.col("expires_at") <= instant(as_of), "expired")
    return cache.withColumn("state", state).filter("state IS NOT NULL")
