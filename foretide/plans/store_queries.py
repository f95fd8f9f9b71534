"""Queries of form, the point-in-time store and ingestion, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.operators import breaker, form, ingestion, pit, rating
from foretide.plans.views import FIXTURES_SQL, OBSERVATIONS_SQL, OBSERVED_AT, fixtures, observations, table

#: Seconds after which the events' types go stale here; one never does, and one is not known.
TTL = {"purchase": 864000, "view": 86400, "click": 432000, "signup": None}
CHAIN = ["s1", "s0", "s2"]


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.sides(fixtures(spark, sf_dir))


def form_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.form(_sides(spark, sf_dir), 5)


def form_last5_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.form(_sides(spark, sf_dir), 5, "home")


def form_last6_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.form_array(_sides(spark, sf_dir))


def current_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.streak(_sides(spark, sf_dir))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.head_to_head(fixtures(spark, sf_dir))


def match_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of a game: a shot is a view, a foul a click, a corner a purchase."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "Shot").when(F.col("event_type") == "click", "Foul Committed").when(F.col("event_type") == "purchase", "Corner").otherwise("Pass")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("match_id"), (k % 2).cast("string").alias("team"), kind.alias("type"), F.when(k % 3 == 0, "Goal").when(k % 3 == 1, "Saved").otherwise("Off T").alias("outcome"), F.when(k % 9 == 0, "Yellow Card").alias("card"), F.when(k % 4 != 0, F.round(F.col("value") / 1000, 3)).alias("xg"))
    return form.match_stats(rows)


def pit_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.query(observations(spark, sf_dir), OBSERVED_AT, data_type="purchase", source="s1", match_id=None).select("point_id", "match_id", "value")


def pit_latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.latest_as_of(observations(spark, sf_dir), OBSERVED_AT, "match_id", "data_type").select("match_id", "data_type", "point_id", "source", "value")


def pit_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the last purchase of the same user before it or at once."""
    rows = observations(spark, sf_dir)
    errors = rows.filter("data_type = 'error'").select("match_id", "point_id", "retrieved_at")
    out = pit.asof_join(errors, rows.filter("data_type = 'purchase'").withColumn("value", F.coalesce("value", F.lit(-1.0))), "match_id", "retrieved_at")
    return out.select("match_id", "point_id", "seen_at", "seen_value")


def pit_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("tenth", F.floor(F.col("value") / 10).cast("long"))
    return pit.exact_dedupe(rows, "match_id", "data_type", "source", "tenth").select("point_id", "copies")


def _ttl():
    out = F.when(F.lit(False), F.lit(0))
    for name, seconds in TTL.items():
        out = out.when(F.col("data_type") == name, F.lit(seconds).cast("int"))
    return out.otherwise(F.lit(-1))


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.freshness(observations(spark, sf_dir), OBSERVED_AT, _ttl()).select("point_id", "age", "freshness")


def usable_for_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.usable_for_forecast(observations(spark, sf_dir), OBSERVED_AT, _ttl()).groupBy("data_type", "freshness").agg(F.count(F.lit(1)).alias("n"))


def datapoint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.create_map(*map(F.lit, ("purchase", "odd", "view", "possession", "click", "probability", "error", "minute", "signup", "score"))), F.col("data_type"))
    rows = pit.validated(observations(spark, sf_dir).withColumn("data_type", kinds))
    return rows.select("point_id", "data_type", F.array_join("issues", ",").alias("issues"), "valid")


def provenance_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumns({"confidence": F.when(F.col("point_id") % 13 == 0, 1.5).otherwise(0.6), "freshness_sec": F.when(F.col("point_id") % 29 == 0, -1.0).otherwise(5.0)})
    codes = F.array_join(pit.contract_violations(rows, ["effective_at", "value"]), ",")
    return rows.groupBy(codes.alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.conflicts(observations(spark, sf_dir), "match_id", "data_type").select("match_id", "data_type", "sources", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def conflict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("retrieved_at", F.date_trunc("day", "retrieved_at").cast("timestamp_ntz"))
    return pit.resolve_conflicts(rows, pit.priority_table(spark, CHAIN), "match_id", "data_type").withColumn("value", F.coalesce(F.round("value", 6), F.lit(-1.0)))


def data_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.quality_score(observations(spark, sf_dir), OBSERVED_AT, ["purchase", "view", "click", "lineups"], _ttl(), "match_id")
    return out.select("match_id", *[F.round(c, 6).alias(c) for c in ("reliability", "freshness", "confirmation", "temporal", "completeness", "score")], "grade")


def data_quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.quality_rates(observations(spark, sf_dir), "source")


def phase_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.floor(F.col("value") * 2 - 300).cast("int")
    return observations(spark, sf_dir).filter("value IS NOT NULL").groupBy(pit.phase(minutes).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("match_id")).agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("kickoff"))


def candidate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.snapshots(observations(spark, sf_dir), _starts(spark, sf_dir), [180, 60, 15]).select("match_id", "lead", "n", "types", "reason", "tier")


def compare_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).filter("value IS NOT NULL")
    one = lambda s, m: pit.latest_as_of(rows.filter(F.col("source") == s).filter(F.col("match_id") % 7 != m), "2024-03-01", "match_id").withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    return pit.compare_latest(one("s0", 1), one("s1", 2), "match_id", "value").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def nearest_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    slots = events.groupBy((F.col("user_id") % 10).alias("place"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot")).agg(F.round(F.avg("value"), 4).alias("value"))
    targets = events.filter("event_type = 'purchase'").select("event_id", (F.col("user_id") % 10).alias("place"), F.col("ts").alias("at"))
    return pit.nearest_slot(targets, slots, "place").select("event_id", "slot", "value", "gap")


def cache_to_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    cache = table(spark, sf_dir, "events").select(k.alias("key"), F.col("props").alias("body"), F.sha2(F.when(k % 41 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")), 256).alias("checksum"), F.col("ts").alias("expires_at"))
    return pit.corrupt_or_expired(cache, OBSERVED_AT).select("key", "state")


def source_priority_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each match and type the best-ranked source that gave a value."""
    rows = observations(spark, sf_dir).join(pit.priority_table(spark, CHAIN), "source").filter("value IS NOT NULL")
    return rows.groupBy("match_id", "data_type").agg(F.min(F.struct("rank", "source")).alias("b")).select("match_id", "data_type", F.col("b.source").alias("source"), F.col("b.rank").alias("rank"))


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).groupBy("match_id", "data_type", "source").agg((F.max("confidence") != "unknown").alias("ok"))
    return ingestion.first_working(rows, pit.priority_table(spark, CHAIN), "match_id", "data_type").withColumn("source", F.coalesce("source", F.lit("none")))


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    return ingestion.budget_windows(rows, most=2, seconds=3600, apart=60)


def cycle_cap_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"), "ts", (F.col("event_id") % 4).alias("cost"))
    return ingestion.cycle_cap(jobs, "day", ["ts", "event_id"], "cost").select("event_id", "before", "state")


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of ten sources, over the ends of days."""
    calls = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_seconds"), F.col("event_id").alias("call_id"), (F.col("event_type") == "view").alias("ok"))
    return breaker.circuit_breaker(calls)


def cycle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 5).alias("matches"), (F.col("o_custkey") % 31).alias("requests"), (F.col("o_orderstatus") == "P").alias("failed"))
    out = ingestion.cycle_statistics(cycles, "o_orderpriority")
    return out.withColumn("alerts", F.array_join(ingestion.alerts(F.col("per_match"), F.col("failure_pct"), F.lit(31)), ","))


def scheduler_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("tier"), F.col("ts").alias("at"), F.col("event_id").alias("run_id"))
    return ingestion.due(runs, "tier", 14400).groupBy("tier").agg(F.count_if("due").alias("due"), F.count(F.lit(1)).alias("n"))


def upcoming_in_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the next five starts after an instant."""
    now = F.lit("2001-07-20 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= now) & (F.col("o_orderdate") <= now + F.expr("INTERVAL 48 HOURS")) & (F.col("o_orderstatus") == "O"))
    return rows.orderBy("o_orderdate", "o_orderkey").limit(5).select("o_orderkey")


def top_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by a weighted key among those that are sure enough."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_discount") * 10, 6).alias("p"), F.count(F.lit(1)).alias("n"))
    key = F.round(F.col("p") * (0.8 + 0.2 * F.least(F.lit(1.0), F.col("n") / 40.0)), 6)
    return rows.filter("p >= 0.5").withColumn("key", key).orderBy(F.desc("key"), "l_partkey").limit(14)


def day_league_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the competitions with the number of games and of those still open."""
    games = fixtures(spark, sf_dir).groupBy(F.col("kickoff").cast("date").cast("string").alias("day"), "competition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src_status") == "O").alias("open"))
    leaf = F.concat_ws(":", "competition", F.col("n").cast("string"), F.col("open").cast("string"))
    return games.groupBy("day").agg(F.sum("n").alias("games"), F.array_join(F.array_sort(F.collect_list(leaf)), ";").alias("tree"))


_TTL_SQL = "CASE data_type WHEN 'purchase' THEN 864000 WHEN 'view' THEN 86400 WHEN 'click' THEN 432000 WHEN 'signup' THEN NULL ELSE -1 END"
_USABLE = f"date_trunc('second', retrieved_at) <= TIMESTAMP '{OBSERVED_AT}' AND coalesce(date_trunc('second', effective_at) <= TIMESTAMP '{OBSERVED_AT}', true)"
_AGE = f"greatest(0, CAST(epoch(TIMESTAMP '{OBSERVED_AT}') AS BIGINT) - CAST(floor(epoch(retrieved_at)) AS BIGINT))"
_FRESH = f"CASE WHEN {_TTL_SQL} = -1 THEN 'ttl_unknown' WHEN {_TTL_SQL} IS NULL THEN 'no_expiry' WHEN {_AGE} <= {_TTL_SQL} THEN 'fresh' ELSE 'stale' END"
_OBS = "WITH " + OBSERVATIONS_SQL
_SIDES = "WITH " + FIXTURES_SQL + """, sides AS (
  SELECT match_id, kickoff, 'home' AS loc, home_id AS team_id, hg AS gf, ag AS ga FROM fixtures UNION ALL SELECT match_id, kickoff, 'away', away_id, ag, hg FROM fixtures),
games AS (SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS result FROM sides)"""


def _form_sql(where: str) -> str:
    return _SIDES + f""", last AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) AS rn FROM games WHERE {where} QUALIFY rn <= 5)
SELECT team_id, count(*) AS played, count(*) FILTER (WHERE result = 'W') AS wins, count(*) FILTER (WHERE result = 'D') AS draws, count(*) FILTER (WHERE result = 'L') AS losses, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga,
  count(*) FILTER (WHERE ga = 0) AS clean_sheets, count(*) FILTER (WHERE gf > 0 AND ga > 0) AS btts, count(*) FILTER (WHERE gf + ga > 2) AS over25, count(*) FILTER (WHERE gf + ga <= 2) AS under25,
  string_agg(result, '' ORDER BY rn) AS form, count(*) >= 5 AS sample_complete FROM last GROUP BY team_id"""


_CHAIN_SQL = "(VALUES ('s1', 1), ('s0', 2), ('s2', 3)) chain(source, rank)"
_SURE = "CASE confidence WHEN 'high' THEN 0.9e0 WHEN 'medium' THEN 0.6e0 WHEN 'low' THEN 0.3e0 ELSE 0e0 END"
QUERIES = {f.__name__: f for f in (
    form_last5, form_last5_home, form_last6_games, current_streak, head_to_head, match_event_stats, pit_as_of, pit_latest_as_of, pit_asof_join, pit_exact_dedupe, freshness_status, usable_for_forecast, datapoint_validation,
    provenance_contract, conflict_detect, conflict_resolve, data_quality_score, data_quality_rates, phase_buckets, candidate_snapshots, compare_pipelines, nearest_slot, cache_to_forget, source_priority_chain, source_fallback,
    rate_limit_windows, cycle_cap_running_sum, circuit_breaker, cycle_statistics, scheduler_due, upcoming_in_horizon, top_picks, day_league_tree,
)}
ORACLES = {
    "form_last5": _form_sql("true"),
    "form_last5_home": _form_sql("loc = 'home'"),
    "form_last6_games": _SIDES + ", last AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) AS rn FROM games QUALIFY rn <= 6) SELECT team_id, string_agg(result || ':' || gf || ':' || ga || ':' || loc, ',' ORDER BY rn) AS games FROM last GROUP BY team_id",
    "current_streak": _SIDES + ", r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) AS rn, first_value(result) OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) AS now FROM games), e AS (SELECT team_id, now, coalesce(min(rn) FILTER (WHERE result <> now), max(rn) + 1) - 1 AS n FROM r GROUP BY team_id, now) SELECT team_id, now || n AS streak FROM e",
    "head_to_head": "WITH " + FIXTURES_SQL + ", p AS (SELECT *, least(home_id, away_id) AS team_a, greatest(home_id, away_id) AS team_b, row_number() OVER (PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY kickoff DESC, match_id DESC) AS rn FROM fixtures QUALIFY rn <= 10) SELECT team_a, team_b, count(*) AS meetings, count(*) FILTER (WHERE (home_id = team_a AND hg > ag) OR (home_id = team_b AND ag > hg)) AS wins_a, count(*) FILTER (WHERE hg = ag) AS draws, count(*) FILTER (WHERE (home_id = team_a AND hg < ag) OR (home_id = team_b AND ag < hg)) AS wins_b FROM p GROUP BY team_a, team_b",
    "match_event_stats": "SELECT user_id % 50 AS match_id, CAST(event_id % 2 AS VARCHAR) AS team, count(*) FILTER (WHERE event_type = 'view') AS shots, count(*) FILTER (WHERE event_type = 'view' AND event_id % 3 < 2) AS on_target, round(sum(CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN round(value / 1000, 3) END), 3) AS xg, count(*) FILTER (WHERE event_type = 'click') AS fouls, count(*) FILTER (WHERE event_id % 9 = 0) AS cards, count(*) FILTER (WHERE event_type = 'purchase') AS corners FROM events GROUP BY 1, 2",
    "pit_as_of": _OBS + f" SELECT point_id, match_id, value FROM observations WHERE data_type = 'purchase' AND source = 's1' AND {_USABLE}",
    "pit_latest_as_of": _OBS + f" SELECT match_id, data_type, point_id, source, value FROM observations WHERE {_USABLE} QUALIFY row_number() OVER (PARTITION BY match_id, data_type ORDER BY retrieved_at DESC, point_id) = 1",
    "pit_asof_join": _OBS + ", e AS (SELECT match_id, point_id, retrieved_at FROM observations WHERE data_type = 'error'), p AS (SELECT match_id, retrieved_at, point_id, coalesce(value, -1) AS value FROM observations WHERE data_type = 'purchase') SELECT e.match_id, e.point_id, p.retrieved_at AS seen_at, p.value AS seen_value FROM e LEFT JOIN p ON p.match_id = e.match_id AND p.retrieved_at <= e.retrieved_at QUALIFY row_number() OVER (PARTITION BY e.match_id, e.point_id ORDER BY p.retrieved_at DESC NULLS LAST, p.point_id DESC) = 1",
    "pit_exact_dedupe": _OBS + " SELECT min(point_id) AS point_id, count(*) AS copies FROM observations GROUP BY match_id, data_type, source, floor(value / 10)",
    "freshness_status": _OBS + f" SELECT point_id, {_AGE} AS age, {_FRESH} AS freshness FROM observations",
    "usable_for_forecast": _OBS + f" SELECT data_type, {_FRESH} AS freshness, count(*) AS n FROM observations WHERE {_USABLE} AND {_FRESH} IN ('fresh', 'no_expiry') GROUP BY 1, 2",
    "datapoint_validation": _OBS + ", k AS (SELECT point_id, CASE data_type WHEN 'purchase' THEN 'odd' WHEN 'view' THEN 'possession' WHEN 'click' THEN 'probability' WHEN 'error' THEN 'minute' ELSE 'score' END AS data_type, value FROM observations), i AS (SELECT *, coalesce(CASE WHEN data_type = 'odd' AND value <= 1 THEN 'odd_too_small' WHEN data_type = 'odd' THEN '' WHEN value NOT BETWEEN 0 AND CASE data_type WHEN 'possession' THEN 100 WHEN 'probability' THEN 1 WHEN 'minute' THEN 130 ELSE 99 END THEN data_type || '_out_of_range' END, '') AS issues FROM k) SELECT point_id, data_type, issues, issues = '' AS valid FROM i",
    "provenance_contract": _OBS + ", v AS (SELECT concat_ws(',', CASE WHEN effective_at IS NULL THEN 'missing:effective_at' END, CASE WHEN value IS NULL THEN 'missing:value' END, CASE WHEN point_id % 13 = 0 THEN 'confidence' END, CASE WHEN point_id % 29 = 0 THEN 'freshness' END) AS violations FROM observations) SELECT violations, count(*) AS n FROM v GROUP BY 1",
    "conflict_detect": _OBS + " SELECT match_id, data_type, count(DISTINCT source) AS sources, round(min(value), 6) AS low, round(max(value), 6) AS high FROM observations WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source) > 1 AND max(value) - min(value) > 1e-9",
    "conflict_resolve": _OBS + f""", r AS (SELECT o.match_id, o.data_type, o.value, chain.rank, date_trunc('day', retrieved_at) AS day, {_SURE} AS sure FROM observations o JOIN {_CHAIN_SQL} ON chain.source = o.source WHERE value IS NOT NULL),
t AS (SELECT *, rank() OVER (PARTITION BY match_id, data_type ORDER BY rank, day DESC, sure DESC) AS place, min(rank) OVER k AS r0, max(rank) OVER k AS r1, min(day) OVER k AS d0, max(day) OVER k AS d1 FROM r WINDOW k AS (PARTITION BY match_id, data_type))
SELECT match_id, data_type, CASE WHEN count(*) > 1 THEN 'UNKNOWN_CRITICAL_CONFLICT' WHEN any_value(r0 < r1) THEN 'PRIORITY_SOURCE' WHEN any_value(d0 < d1) THEN 'RECENCY_TIEBREAK' ELSE 'CONFIDENCE_TIEBREAK' END AS decision, CASE WHEN count(*) = 1 THEN round(min(value), 6) ELSE -1 END AS value, min(value) = max(value) AS values_agree FROM t WHERE place = 1 GROUP BY 1, 2""",
    "data_quality_score": _OBS + f""", s AS (SELECT *, {_SURE} AS sure, CASE WHEN {_TTL_SQL} = -1 THEN 0e0 WHEN {_TTL_SQL} IS NULL THEN 1e0 ELSE greatest(0e0, 1 - {_AGE} / CAST({_TTL_SQL} AS DOUBLE)) END AS fresh FROM observations WHERE value IS NOT NULL AND {_USABLE}),
t AS (SELECT match_id, data_type, count(DISTINCT source) > 1 AS confirmed FROM s GROUP BY 1, 2), c AS (SELECT match_id, avg(CASE WHEN confirmed THEN 1e0 ELSE 0e0 END) AS confirmation, count(*) FILTER (WHERE data_type IN ('purchase', 'view', 'click', 'lineups')) / 4e0 AS completeness FROM t GROUP BY 1),
p AS (SELECT s.match_id, avg(sure) AS reliability, avg(fresh) AS freshness, any_value(confirmation) AS confirmation, avg(CASE WHEN effective_at IS NULL THEN 0e0 ELSE 1e0 END) AS temporal, any_value(completeness) AS completeness FROM s JOIN c ON c.match_id = s.match_id GROUP BY 1),
w AS (SELECT *, 0.30e0 * reliability + 0.25e0 * freshness + 0.20e0 * confirmation + 0.15e0 * temporal + 0.10e0 * completeness AS score FROM p)
SELECT match_id, round(reliability, 6) AS reliability, round(freshness, 6) AS freshness, round(confirmation, 6) AS confirmation, round(temporal, 6) AS temporal, round(completeness, 6) AS completeness, round(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.70 THEN 'B' WHEN score >= 0.50 THEN 'C' ELSE 'D' END AS grade FROM w""",
    "data_quality_rates": _OBS + " SELECT source, count(*) AS n, round(count(*) FILTER (WHERE is_unknown) / CAST(count(*) AS DOUBLE), 4) AS unknown_rate, round(count(*) FILTER (WHERE confidence = 'high') / CAST(count(*) AS DOUBLE), 4) AS high_rate, round(count(effective_at) / CAST(count(*) AS DOUBLE), 4) AS timed_rate FROM observations GROUP BY source",
    "phase_buckets": _OBS + ", m AS (SELECT CAST(floor(value * 2 - 300) AS INTEGER) AS m FROM observations WHERE value IS NOT NULL) SELECT CASE WHEN m < -150 THEN 'POST' WHEN m < 0 THEN 'LIVE' WHEN m <= 15 THEN 'T-15' WHEN m <= 60 THEN 'T-60' WHEN m <= 180 THEN 'T-180' ELSE 'HORIZON' END AS phase, count(*) AS n FROM m GROUP BY 1",
    "candidate_snapshots": _OBS + ", k AS (SELECT user_id AS match_id, max(ts) - INTERVAL 2 DAY AS kickoff FROM events GROUP BY 1), w AS (SELECT match_id, lead, kickoff - to_minutes(lead) AS as_of FROM k, (VALUES (180), (60), (15)) t(lead)), j AS (SELECT w.match_id, lead, data_type, coalesce(value IS NOT NULL AND date_trunc('second', retrieved_at) <= as_of AND coalesce(date_trunc('second', effective_at) <= as_of, true), false) AS ok FROM w LEFT JOIN observations o ON o.match_id = w.match_id), g AS (SELECT match_id, lead, count(*) FILTER (WHERE ok) AS n, coalesce(string_agg(DISTINCT data_type, ',' ORDER BY data_type) FILTER (WHERE ok), '') AS types, count(DISTINCT data_type) FILTER (WHERE ok) AS kinds FROM j GROUP BY 1, 2) SELECT match_id, lead, n, types, CASE WHEN n = 0 THEN 'NO_USABLE_DATA' ELSE 'OK' END AS reason, CASE WHEN n = 0 THEN 'none' WHEN kinds >= 5 THEN 'high' WHEN kinds >= 3 THEN 'medium' ELSE 'low' END AS tier FROM g",
    "compare_pipelines": _OBS + ", l AS (SELECT source, match_id, floor(value / 100) AS value FROM observations WHERE value IS NOT NULL AND retrieved_at <= TIMESTAMP '2024-03-01' AND coalesce(effective_at <= TIMESTAMP '2024-03-01', true) AND ((source = 's0' AND match_id % 7 <> 1) OR (source = 's1' AND match_id % 7 <> 2)) QUALIFY row_number() OVER (PARTITION BY source, match_id ORDER BY retrieved_at DESC, point_id) = 1) SELECT CASE WHEN a.match_id IS NULL THEN 'only_b' WHEN b.match_id IS NULL THEN 'only_a' WHEN a.value = b.value THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM (SELECT * FROM l WHERE source = 's0') a FULL JOIN (SELECT * FROM l WHERE source = 's1') b ON a.match_id = b.match_id GROUP BY 1",
    "nearest_slot": "WITH s AS (SELECT user_id % 10 AS place, date_trunc('hour', ts) AS slot, round(avg(value), 4) AS value FROM events GROUP BY 1, 2), t AS (SELECT event_id, user_id % 10 AS place, ts AS wanted FROM events WHERE event_type = 'purchase'), j AS (SELECT event_id, slot, value, abs(CAST(floor(epoch(slot)) AS BIGINT) - CAST(floor(epoch(wanted)) AS BIGINT)) AS off FROM t JOIN s ON s.place = t.place AND slot BETWEEN wanted - INTERVAL 1 HOUR AND wanted + INTERVAL 1 HOUR) SELECT event_id, slot, value, off > 1800 AS gap FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY off, slot) = 1",
    "cache_to_forget": f"SELECT event_id AS key, CASE WHEN event_id % 41 = 0 THEN 'corrupt' ELSE 'expired' END AS state FROM events WHERE event_id % 41 = 0 OR ts <= TIMESTAMP '{OBSERVED_AT}'",
    "source_priority_chain": _OBS + f" SELECT match_id, data_type, arg_min(o.source, rank) AS source, min(rank) AS rank FROM observations o JOIN {_CHAIN_SQL} ON chain.source = o.source WHERE value IS NOT NULL GROUP BY 1, 2",
    "source_fallback": _OBS + f", g AS (SELECT match_id, data_type, source, max(confidence) <> 'unknown' AS ok FROM observations GROUP BY 1, 2, 3) SELECT match_id, data_type, coalesce(arg_min(g.source, rank) FILTER (WHERE ok), 'none') AS source, count(*) FILTER (WHERE NOT ok) AS failed FROM g JOIN {_CHAIN_SQL} ON chain.source = g.source GROUP BY 1, 2",
    "rate_limit_windows": "WITH r AS (SELECT 's' || (event_id % 3) AS source, ts, ts - lag(ts) OVER (PARTITION BY event_id % 3 ORDER BY ts, event_id) < INTERVAL 60 SECOND AS soon FROM events), g AS (SELECT source, CAST(floor(floor(epoch(ts)) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n, count(*) FILTER (WHERE soon) AS too_soon FROM r GROUP BY 1, 2) SELECT *, greatest(n - 2, 0) AS over_budget FROM g",
    "cycle_cap_running_sum": "SELECT event_id, CAST(coalesce(sum(event_id % 4) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CASE WHEN before < 20 THEN 'RUN' ELSE 'CYCLE_CAP' END AS state FROM events",
    "circuit_breaker": """WITH RECURSIVE c AS (
  SELECT 's' || (user_id % 10) AS source, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS call_id, event_type = 'view' AS ok,
         row_number() OVER (PARTITION BY user_id % 10 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events
), f AS (
  SELECT source, call_id, rn, CASE WHEN ok THEN 0 ELSE 1 END AS failed, CAST(NULL AS BIGINT) AS since, 'CLOSED' AS state FROM c WHERE rn = 1
  UNION ALL
  SELECT c.source, c.call_id, c.rn,
         CASE WHEN f.since IS NOT NULL AND t - f.since < 1800 THEN f.failed WHEN ok THEN 0 ELSE f.failed + 1 END,
         CASE WHEN f.since IS NOT NULL AND t - f.since < 1800 THEN f.since WHEN NOT ok AND f.failed + 1 >= 5 THEN t END,
         CASE WHEN f.since IS NULL THEN 'CLOSED' WHEN t - f.since < 1800 THEN 'REFUSED' ELSE 'HALF_OPEN' END
  FROM f JOIN c ON c.source = f.source AND c.rn = f.rn + 1
) SELECT source, call_id, state FROM f""",
    "cycle_statistics": "WITH c AS (SELECT o_orderpriority, CAST(sum(o_orderkey % 5) AS BIGINT) AS matches, CAST(sum(o_custkey % 31) AS BIGINT) AS requests, round(sum(o_custkey % 31) / CAST(sum(o_orderkey % 5) AS DOUBLE), 2) AS per_match, round(100 * count(*) FILTER (WHERE o_orderstatus = 'P') / CAST(count(*) AS DOUBLE), 1) AS failure_pct FROM orders GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN per_match > 20 THEN 'ERROR_REQUESTS' WHEN per_match > 8 THEN 'WARN_REQUESTS' END, CASE WHEN failure_pct > 50 THEN 'FAILURES' END, 'IDENTITY_UNKNOWN') AS alerts FROM c",
    "scheduler_due": "WITH r AS (SELECT user_id AS tier, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT tier, count(*) FILTER (WHERE gap IS NULL OR gap >= 14400) AS due, count(*) AS n FROM r GROUP BY tier",
    "upcoming_in_horizon": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '2001-07-20' AND TIMESTAMP '2001-07-22' AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 5",
    "top_picks": "WITH g AS (SELECT l_partkey, round(avg(l_discount) * 10, 6) AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT *, round(p * (0.8e0 + 0.2e0 * least(1e0, n / 40e0)), 6) AS key FROM g WHERE p >= 0.5 ORDER BY key DESC, l_partkey LIMIT 14",
    "day_league_tree": "WITH " + FIXTURES_SQL + ", g AS (SELECT CAST(CAST(kickoff AS DATE) AS VARCHAR) AS day, competition, count(*) AS n, count(*) FILTER (WHERE src_status = 'O') AS open FROM fixtures GROUP BY 1, 2) SELECT day, CAST(sum(n) AS BIGINT) AS games, string_agg(competition || ':' || n || ':' || open, ';' ORDER BY competition || ':' || n || ':' || open) AS tree FROM g GROUP BY day",
}
