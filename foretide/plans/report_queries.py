"""Queries of operations reports, entities and other scalar rules, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions import numbers, text, time
from foretide.operators import form, identity, ingestion, ledger, rating, reports
from foretide.plans.views import FIXTURES_SQL, OBSERVATIONS_SQL, OBSERVED_AT, fixtures, observations, table
from foretide.sources import access


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    source = F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("match_id"), source.alias("source"), level.alias("level"), F.col("event_type").alias("kind"), F.col("value"))


def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_alerts(_log(spark, sf_dir), "error", 20).select("id", "match_id")


def journal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.journal_entries(_log(spark, sf_dir), OBSERVED_AT, source="s1", kind=None, level="warning").select("id", "match_id")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by both parts of its key."""
    return reports.journal_entries(_log(spark, sf_dir), source="s2", id=137).select("id", "source", "kind")


def journal_without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.create_map(F.lit("Token"), F.lit("x"), F.lit("kind"), F.col("kind"), F.lit("api_key"), F.col("source"), F.lit("level"), F.col("level"))
    rows = ingestion.journal(_log(spark, sf_dir).withColumn("detail", detail), ["token", "api_key"])
    return rows.select("id", F.to_json("detail").alias("detail"))


def last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_entries(_log(spark, sf_dir), "match_id", 4).select("match_id", "nth", "id")


def named_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return reports.counters(rows, F.concat_ws(".", "source", "kind"), F.lit(1), F.col("value"))


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 0, "DONE_WITH_ERRORS").otherwise("DONE")
    end = F.when(k % 5 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(k.alias("cycle_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), end.alias("finished_at"), (k % 7).alias("matches"), (F.col("o_custkey") % 31).alias("requests"))


def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.data_health(_cycles(spark, sf_dir))


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in ("orders", "customer", "part")}
    errors = _log(spark, sf_dir).select("source", F.when(F.col("level") == "error", "ERROR").otherwise("OK").alias("status"))
    return reports.status_report(_cycles(spark, sf_dir), tables, errors)


def registry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    held = F.filter(F.array(*map(F.lit, ("active", "disabled", "forbidden"))), lambda x: (x != "disabled") | (k % 5 != 0))
    rows = table(spark, sf_dir, "customer").select(F.when(k % 50 == 0, k + 1).otherwise(k).alias("source_id"), held.alias("statuses"), F.when(k % 7 != 0, F.col("c_name")).alias("name"), F.when(k % 11 == 0, "").otherwise("https").alias("base_url"))
    found = reports.registry_faults(rows, ["active", "disabled", "forbidden"], ["name", "base_url"])
    return found.groupBy(F.array_join("faults", ",").alias("faults")).agg(F.count(F.lit(1)).alias("n"))


def provenance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.provenance(observations(spark, sf_dir), OBSERVED_AT).select("point_id", "effective_at", "confidence", "freshness_sec")


def points_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's latest points of a match, as one text."""
    out = reports.points_by_type(observations(spark, sf_dir), "match_id", 3)
    entries = F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"].cast("array<string>"), "+")))
    return out.select("match_id", F.array_join(entries, ",").alias("points"))


def form_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of the teams that played in the last days, of all teams there are."""
    held = rating.sides(fixtures(spark, sf_dir).filter("kickoff >= '2001-07-25'"))
    teams = spark.range(24).select(F.col("id").alias("team_id"))
    found = reports.form_points(form.form(held, 5), teams, 5, ["played"])
    return found.select("team_id", "data_type", "level", F.coalesce(F.get_json_object("value", "$.played"), F.lit("none")).alias("played"), F.array_join("issues", ",").alias("issues"))


def decoded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.when(F.col("event_id") % 40 == 0, "{broken").otherwise(F.col("props")).alias("value_json"), (F.col("event_id") % 11 == 0).alias("is_unknown"))
    return reports.decoded(rows, "k INT").select("point_id", F.coalesce("value.k", F.lit(-1)).alias("k"), F.coalesce("is_unknown", F.lit(True)).alias("unknown"))


def jobs_of_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.element_at(F.array(*map(F.lit, ("T-180", "T-60", "T-15"))), (F.col("event_id") % 3 + 1).cast("int"))
    jobs = _log(spark, sf_dir).withColumnRenamed("id", "event_id").withColumn("phase", phase)
    parts = [reports.of_tier(jobs, tier).agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("n")) for tier in ("calendar", "T-60", "T-15")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def identity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("data_type", F.when(F.col("data_type") == "view", "identity_decision").otherwise(F.col("data_type")))
    return reports.identity_decisions(rows.withColumn("value", F.coalesce("value", F.lit(-1.0)))).withColumn("decision", F.round("decision", 4))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).select("source", F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 6 != 0, F.col("at")).alias("expires_at"))
    return reports.cache_entries(rows, OBSERVED_AT)


def source_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources may be asked for odds, by how much is wanted, and why the others may not."""
    k = F.col("s_suppkey")
    has = F.element_at(F.array(*map(F.lit, ("true", "partial", "unknown", "false"))), (k % 4 + 1).cast("int"))
    status = F.when(k % 9 == 0, "forbidden").when(k % 10 == 0, "disabled").otherwise("active")
    rows = table(spark, sf_dir, "supplier").select(k.alias("source_id"), (k % 6 != 0).alias("enabled"), status.alias("status"), F.when(k % 5 != 0, F.create_map(F.lit("odds"), has)).otherwise(F.create_map(F.lit("x"), F.lit("true"))).alias("capabilities"))
    strict = access.eligible(rows, "odds").select("source_id", F.lit("strict").alias("list"), F.lit("").alias("reasons"))
    wide = access.eligible(rows, "odds", ("true", "partial", "unknown")).select("source_id", F.lit("wide").alias("list"), F.lit("").alias("reasons"))
    why = access.rejections(rows, "odds").select("source_id", F.lit("rejected").alias("list"), F.array_join("reasons", ",").alias("reasons"))
    return strict.unionByName(wide).unionByName(why)


def entity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal keys to the surest external id in use, and how many sources an exported key has."""
    rows = _entities(spark, sf_dir)
    held = identity.entity_map(rows)
    sources = identity.exported_map(rows).select("internal_key", F.size("sources").alias("sources"))
    return held.join(sources, "internal_key").select("source", "internal_key", "external_id", F.round("confidence", 4).alias("confidence"), "sources")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    confidence = F.round(0.7 + F.col("l_discount") * 3, 4)
    status = F.when(confidence >= 0.95, "MATCH_AUTO").when(confidence >= 0.8, "MATCH_JOURNALIZED").otherwise("UNKNOWN")
    return table(spark, sf_dir, "lineitem").select(F.lit("team").alias("entity_type"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (F.col("l_partkey") % 300).alias("internal_key"), (F.col("l_suppkey") % 40).alias("external_id"), confidence.alias("confidence"), status.alias("status"))


def entity_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams that decided identities prove, of one source."""
    k = F.col("o_orderkey")
    matches = table(spark, sf_dir, "orders").select(k.alias("match_id"), F.when(k % 2 == 0, "s0").otherwise("s1").alias("source"), F.concat(F.lit("home "), (k % 90).cast("string")).alias("home"), F.when(k % 5 != 0, k % 90).alias("home_ext_id"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("away "), (k % 80).cast("string"))).alias("away"), (k % 80).alias("away_ext_id"))
    decisions = matches.select("match_id", ((F.col("match_id") % 10) / 10).alias("confidence"))
    found = identity.seeds(matches, decisions, "s0")
    return found.groupBy("internal_key", "external_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 4).alias("confidence"))


def venue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as those of venues, asked for by parts of them (J14), and whether the answer sounds like a stadium."""
    types = table(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name")).distinct()
    words = F.split("name", " ")
    venues = types.select(F.concat(F.lit("v:"), F.col("name")).alias("venue_id"), F.concat("name", F.when(F.char_length("name") % 2 == 0, " arena").otherwise(" hall")).alias("name"), F.get(words, F.lit(0)).alias("city"), F.when(F.char_length("name") % 3 != 0, "x").alias("country"))
    part = F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(2)))
    asked = types.select(F.concat(F.lit("whole "), F.col("name")).alias("asked_id"), F.col("name"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country"))
    asked = asked.unionByName(types.select(F.concat(F.lit("part "), F.col("name")).alias("asked_id"), part.alias("name"), F.get(words, F.lit(0)).alias("city"), F.lit(None).cast("string").alias("country")))
    asked = asked.unionByName(types.select(F.concat(F.lit("open "), F.col("name")).alias("asked_id"), part.alias("name"), F.lit(None).cast("string").alias("city"), F.lit("y").alias("country")))
    found = identity.venue_lookup(asked, venues).join(venues.select("venue_id", F.col("name").alias("venue")), "venue_id", "left")
    return found.select("asked_id", F.coalesce("venue_id", F.lit("")).alias("venue_id"), identity.looks_like_stadium(F.col("venue")).alias("stadium"))


def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair odds, momentum, decided markets, rounding to even, small pictures, minutes."""
    k = F.col("o_orderkey")
    market = F.element_at(F.array(*map(F.lit, ("over 1.5", "under 2.5", "both score", "home"))), (k % 4 + 1).cast("int"))
    url = F.concat(F.when(k % 2 == 0, "https://cdn.example/a").otherwise("https://other.example/a"), k.cast("string"), F.lit("?size=9"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.fair_odds((k % 40 + 1) / 64).alias("fair"), F.round(numbers.momentum(k % 7, k % 5, F.when(k % 3 != 0, (k % 101).cast("double"))), 6).alias("momentum"),
        ledger.market_decided(market, k % 3, k % 2).alias("decided"), numbers.round_half_even((k % 64) / 8.0, 2).alias("even"), text.thumbnail(url, "cdn.example").alias("picture"),
        F.date_format(time.minute_bucket(F.col("o_orderdate") + F.make_dt_interval(secs=(k % 200).cast("double"))), "yyyy-MM-dd HH:mm").alias("minute"),
    )


def date_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of days that cover a year, and the orders in each."""
    chunks = spark.range(1).select(F.explode(time.date_chunks("2000-01-01", "2000-12-31", 9)).alias("c")).select("c.*")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).filter("day >= '2000-01-01' AND day <= '2000-12-31'")
    start = F.date_add(F.lit("2000-01-01").cast("date"), F.floor(F.datediff("day", F.lit("2000-01-01").cast("date")) / 9).cast("int") * 9)
    counts = days.groupBy(start.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    return chunks.join(counts, "first", "left").select(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.coalesce("n", F.lit(0)).alias("n"))


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on the form of both sides of each fixture to come."""
    games = rating.sides(fixtures(spark, sf_dir).filter("kickoff < '2001-06-01'"))
    wins = form.form(games, 5).select("team_id", "wins")
    coming = fixtures(spark, sf_dir).filter("kickoff >= '2001-07-01'").select("match_id", "home_id", "away_id")
    both = coming.join(wins.select(F.col("team_id").alias("home_id"), F.col("wins").alias("home_wins")), "home_id").join(wins.select(F.col("team_id").alias("away_id"), F.col("wins").alias("away_wins")), "away_id")
    name = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string"))
    return both.select("match_id", text.form_sentence(name("home_id"), name("away_id"), F.col("home_wins"), F.col("away_wins")).alias("sentence"))


QUERIES = {f.__name__: f for f in (
    recent_alerts, journal_entries, point_lookup, journal_without_secrets, last_entries, named_counters, data_health, status_report, registry_faults, provenance_projection, points_by_type, form_points,
    decoded_points, jobs_of_tier, identity_decisions, cache_entries, source_eligibility, entity_map, entity_seeds, venue_lookup, scalar_rules, date_chunks, narratives,
)}
_LOG = "WITH log AS (SELECT event_id AS id, ts AS t, user_id AS match_id, 's' || (event_id % 3) AS source, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS level, event_type AS kind, value FROM events)"
_CYCLES = "cycles AS (SELECT o_orderkey AS cycle_id, CASE WHEN o_orderkey % 4 = 0 THEN 'DONE_WITH_ERRORS' ELSE 'DONE' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS finished_at, o_orderkey % 7 AS m, o_custkey % 31 AS r FROM orders)"
_HEALTH = "health AS (SELECT CASE arg_max(status, row(finished_at, cycle_id)) FILTER (WHERE finished_at IS NOT NULL) WHEN 'DONE' THEN 'ok' ELSE 'degraded' END AS health, arg_max(cycle_id, row(finished_at, cycle_id)) FILTER (WHERE finished_at IS NOT NULL AND status = 'DONE') AS last_successful, count(*) AS cycles, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(r) AS BIGINT) AS requests FROM cycles)"
_TYPES = "t AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS name FROM part)"
_HAS = "CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE ['true', 'partial', 'unknown', 'false'][s_suppkey % 4 + 1] END"
ORACLES = {
    "recent_alerts": _LOG + " SELECT id, match_id FROM log WHERE level = 'error' ORDER BY id DESC LIMIT 20",
    "journal_entries": _LOG + f" SELECT id, match_id FROM log WHERE source = 's1' AND level = 'warning' AND t >= TIMESTAMP '{OBSERVED_AT}'",
    "point_lookup": _LOG + " SELECT id, source, kind FROM log WHERE source = 's2' AND id = 137",
    "journal_without_secrets": _LOG + " SELECT id, '{\"kind\":\"' || kind || '\",\"level\":\"' || level || '\"}' AS detail FROM log",
    "last_entries": _LOG + " SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY t DESC, id DESC) AS INTEGER) AS nth, id FROM log QUALIFY nth <= 4",
    "named_counters": _LOG + " SELECT source || '.' || kind AS name, count(*) AS total, count(*) AS entries, round(avg(value), 4) AS mean_seconds FROM log GROUP BY 1",
    "data_health": f"WITH {_CYCLES}, {_HEALTH} SELECT * FROM health",
    "status_report": _LOG + f", {_CYCLES}, {_HEALTH}" + """ SELECT 'cycles' AS section, item, value FROM (SELECT health, last_successful::VARCHAR AS last_successful, cycles::VARCHAR AS cycles, matches::VARCHAR AS matches, requests::VARCHAR AS requests FROM health) UNPIVOT (value FOR item IN (health, last_successful, cycles, matches, requests))
      UNION ALL SELECT 'rows', 'orders', count(*)::VARCHAR FROM orders UNION ALL SELECT 'rows', 'customer', count(*)::VARCHAR FROM customer UNION ALL SELECT 'rows', 'part', count(*)::VARCHAR FROM part
      UNION ALL SELECT 'errors', source, (count(*) FILTER (WHERE level = 'error'))::VARCHAR FROM log GROUP BY source""",
    "registry_faults": "WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1 ELSE c_custkey END AS id FROM customer), f AS (SELECT concat_ws(',', CASE WHEN k % 5 = 0 THEN 'STATUS_disabled' END, CASE WHEN k % 7 = 0 THEN 'MISSING_name' END, CASE WHEN k % 11 = 0 THEN 'MISSING_base_url' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'DUPLICATE' END) AS faults FROM r) SELECT faults, count(*) AS n FROM f WHERE faults <> '' GROUP BY 1",
    "provenance_projection": "WITH " + OBSERVATIONS_SQL + f" SELECT point_id, coalesce(effective_at, retrieved_at) AS effective_at, CASE confidence WHEN 'high' THEN 0.9e0 WHEN 'medium' THEN 0.6e0 WHEN 'low' THEN 0.3e0 ELSE 0e0 END AS confidence, greatest(CAST(epoch(TIMESTAMP '{OBSERVED_AT}') AS BIGINT) - CAST(floor(epoch(retrieved_at)) AS BIGINT), 0) AS freshness_sec FROM observations",
    "points_by_type": "WITH " + OBSERVATIONS_SQL + ", l AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY match_id, data_type ORDER BY retrieved_at DESC, point_id DESC) <= 3), g AS (SELECT match_id, data_type || '=' || string_agg(point_id::VARCHAR, '+' ORDER BY retrieved_at, point_id) AS p FROM l GROUP BY match_id, data_type) SELECT match_id, string_agg(p, ',' ORDER BY p) AS points FROM g GROUP BY match_id",
    "form_points": "WITH " + FIXTURES_SQL + ", s AS (SELECT home_id AS team_id FROM fixtures WHERE kickoff >= TIMESTAMP '2001-07-25' UNION ALL SELECT away_id FROM fixtures WHERE kickoff >= TIMESTAMP '2001-07-25'), c AS (SELECT team_id, least(count(*), 5) AS n FROM s GROUP BY 1) SELECT t.range AS team_id, 'form_last_5' AS data_type, CASE WHEN n IS NULL THEN 'UNKNOWN' ELSE 'AGGREGATED' END AS level, coalesce(n::VARCHAR, 'none') AS played, CASE WHEN n IS NULL THEN 'NO_COMPLETED_MATCHES_IN_WINDOW' ELSE '' END AS issues FROM range(24) t LEFT JOIN c ON c.team_id = t.range",
    "decoded_points": "SELECT event_id AS point_id, CASE WHEN event_id % 40 = 0 THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) END AS k, event_id % 11 = 0 AS unknown FROM events",
    "jobs_of_tier": "SELECT 'calendar' AS tier, count(*) AS n FROM events UNION ALL SELECT 'T-60', count(*) FILTER (WHERE event_id % 3 = 1) FROM events UNION ALL SELECT 'T-15', count(*) FILTER (WHERE event_id % 3 = 2) FROM events",
    "identity_decisions": "WITH " + OBSERVATIONS_SQL + " SELECT match_id, round(arg_min(coalesce(value, -1), row(retrieved_at, point_id)), 4) AS decision FROM observations WHERE data_type = 'view' GROUP BY match_id",
    "cache_entries": _LOG + f" SELECT substr(sha256(source || '|https://x/' || id), 1, 16) AS key_hash, source, id % 6 = 0 OR t > TIMESTAMP '{OBSERVED_AT}' AS alive FROM log",
    "source_eligibility": f"""WITH s AS (SELECT s_suppkey AS source_id, s_suppkey % 6 <> 0 AS enabled, CASE WHEN s_suppkey % 9 = 0 THEN 'forbidden' WHEN s_suppkey % 10 = 0 THEN 'disabled' ELSE 'active' END AS status, {_HAS} AS has FROM supplier)
      SELECT source_id, 'strict' AS list, '' AS reasons FROM s WHERE enabled AND status = 'active' AND has = 'true' UNION ALL SELECT source_id, 'wide', '' FROM s WHERE enabled AND status = 'active' AND has <> 'false'
      UNION ALL SELECT source_id, 'rejected', concat_ws(',', CASE WHEN NOT enabled THEN 'DISABLED' END, CASE WHEN status <> 'active' THEN 'STATUS' END, CASE WHEN has <> 'true' THEN 'CAPABILITY_' || upper(has) END) FROM s WHERE NOT enabled OR status <> 'active' OR has <> 'true'""",
    "entity_map": """WITH e AS (SELECT 's' || (l_orderkey % 3) AS source, l_partkey % 300 AS internal_key, l_suppkey % 40 AS external_id, round(0.7e0 + l_discount * 3, 4) AS confidence FROM lineitem),
      n AS (SELECT internal_key, CAST(count(DISTINCT source) AS INTEGER) AS sources FROM e GROUP BY 1)
      SELECT source, e.internal_key, arg_min(external_id, row(-confidence, external_id)) AS external_id, round(max(confidence), 4) AS confidence, any_value(sources) AS sources FROM e JOIN n ON n.internal_key = e.internal_key WHERE confidence >= 0.8e0 GROUP BY source, e.internal_key""",
    "entity_seeds": """WITH m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 >= 8), s AS (SELECT 'home ' || (k % 90) AS name, (k % 90)::VARCHAR AS external_id, k FROM m WHERE k % 5 <> 0 UNION ALL SELECT 'away ' || (k % 80), (k % 80)::VARCHAR, k FROM m WHERE k % 8 <> 0)
      SELECT substr(sha256(name), 1, 16) AS internal_key, external_id, count(*) AS n, round(max((k % 10) / 10e0), 4) AS confidence FROM s GROUP BY 1, 2""",
    "venue_lookup": f"""WITH {_TYPES}, v AS (SELECT 'v:' || name AS venue_id, name || CASE WHEN length(name) % 2 = 0 THEN ' arena' ELSE ' hall' END AS vname, split_part(name, ' ', 1) AS vcity, CASE WHEN length(name) % 3 <> 0 THEN 'x' ELSE '' END AS vcountry FROM t),
      a AS (SELECT 'whole ' || name AS asked_id, name, '' AS city, '' AS country FROM t UNION ALL SELECT 'part ' || name, substr(name, length(split_part(name, ' ', 1)) + 2), split_part(name, ' ', 1), '' FROM t UNION ALL SELECT 'open ' || name, substr(name, length(split_part(name, ' ', 1)) + 2), '', 'y' FROM t),
      m AS (SELECT asked_id, count(*) AS n, min(venue_id) AS venue_id, min(vname) AS vname FROM a JOIN v ON (contains(vname, name) OR contains(name, vname)) AND (city = '' OR vcity = '' OR city = vcity) AND (country = '' OR vcountry = '' OR country = vcountry) GROUP BY asked_id)
      SELECT a.asked_id, CASE WHEN n = 1 THEN venue_id ELSE '' END AS venue_id, coalesce(n = 1 AND contains(vname, 'arena'), false) AS stadium FROM a LEFT JOIN m ON m.asked_id = a.asked_id""",
    "scalar_rules": """WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)
      SELECT k AS o_orderkey, round(64e0 / (k % 40 + 1), 3) AS fair, round(least(greatest(0.55e0 * CASE WHEN k % 7 + k % 5 > 0 THEN (k % 7) / CAST(k % 7 + k % 5 AS DOUBLE) ELSE 0.5e0 END + 0.45e0 * CASE WHEN k % 3 <> 0 THEN (k % 101) / 100e0 ELSE 0.5e0 END, 0.05e0), 0.95e0), 6) AS momentum,
        CASE k % 4 WHEN 0 THEN k % 3 + k % 2 > 1.5 WHEN 1 THEN k % 3 + k % 2 > 2.5 WHEN 2 THEN k % 3 > 0 AND k % 2 > 0 ELSE false END AS decided, round_even(CAST((k % 64) / 8e0 AS DOUBLE), 2) AS even,
        CASE WHEN k % 2 = 0 THEN 'https://cdn.example/a' || k || '?w=64' ELSE 'https://other.example/a' || k || '?size=9' END AS picture, strftime(d + to_seconds(k % 200), '%Y-%m-%d %H:%M') AS minute FROM o""",
    "date_chunks": "WITH c AS (SELECT CAST(x AS DATE) AS first FROM range(DATE '2000-01-01', DATE '2001-01-01', INTERVAL 9 DAY) t(x)), o AS (SELECT DATE '2000-01-01' + CAST(floor((CAST(o_orderdate AS DATE) - DATE '2000-01-01') / 9) * 9 AS INTEGER) AS first, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1) SELECT c.first::VARCHAR AS first, least(c.first + 8, DATE '2000-12-31')::VARCHAR AS last, coalesce(n, 0) AS n FROM c LEFT JOIN o ON o.first = c.first",
    "narratives": "WITH " + FIXTURES_SQL + """, s AS (SELECT match_id, kickoff, home_id AS team_id, hg > ag AS w FROM fixtures WHERE kickoff < TIMESTAMP '2001-06-01' UNION ALL SELECT match_id, kickoff, away_id, ag > hg FROM fixtures WHERE kickoff < TIMESTAMP '2001-06-01'),
      l AS (SELECT team_id, w FROM s QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) <= 5), f AS (SELECT team_id, count(*) FILTER (WHERE w) AS wins FROM l GROUP BY 1)
      SELECT match_id, CASE WHEN h.wins > a.wins + 1 THEN 'Team ' || home_id || ' comes in better form (' || h.wins || ' wins) than Team ' || away_id || ' (' || a.wins || ').' WHEN a.wins > h.wins + 1 THEN 'Team ' || away_id || ' comes in better form (' || a.wins || ' wins) than Team ' || home_id || ' (' || h.wins || ').'
        ELSE 'Team ' || home_id || ' (' || h.wins || ' wins) and Team ' || away_id || ' (' || a.wins || ') are in like form.' END AS sentence FROM fixtures JOIN f h ON h.team_id = home_id JOIN f a ON a.team_id = away_id WHERE kickoff >= TIMESTAMP '2001-07-01'""",
}
