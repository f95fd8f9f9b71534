"""Queries of smaller functions and of details: hosts, days, instants, keys, line-ups, claims, weather, landing files, with SQL that gives
the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions import text, time
from foretide.operators import identity, pit
from foretide.plans.feed_queries import _NAME, _drained, _names, _stream, team_events
from foretide.plans.views import OBSERVATIONS_SQL, OBSERVED_AT, observations, table
from foretide.sources import landing, parsers
from foretide.streaming import pipelines
from foretide.streaming.scratch import shared_folder


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19."""
    return table(spark, sf_dir, "pages").groupBy(F.coalesce(text.host(F.col("url")), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def parsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D07."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(d, "dd/MM/yy")).when(k % 4 == 2, F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(time.parse_day(raw).cast("string"), F.lit("")).alias("day"))


def agreement_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D08."""
    rows = table(spark, sf_dir, "orders").withColumn("other", F.expr("o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 3000 AS INT) - 1500)"))
    by_day, by_time = identity.agreement(F.col("o_orderdate"), F.col("other"))
    return rows.select("o_orderkey", F.coalesce(by_day, F.lit(0.0)).alias("by_day"), F.coalesce(by_time, F.lit(0.0)).alias("by_time"))


def tolerant_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z20."""
    k, minute = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    raw = F.when(k % 5 == 0, F.concat(minute, F.lit("Z"))).when(k % 5 == 1, F.concat(minute, F.lit(":07.250z"))).when(k % 5 == 2, F.concat(minute, F.lit(":59+05:00"))).when(k % 5 == 3, minute).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(time.tolerant_seconds(raw), F.lit(-1)).alias("at"))


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a name that the book knows, else the name itself."""
    names = _names(spark, sf_dir).withColumn("normal", text.normal_name(F.col("name")))
    known = names.filter("team_id % 3 = 0").select(F.col("name").alias("alias"), F.concat(F.lit("t"), (F.col("team_id") % 7).cast("string")).alias("canonical_id"), F.col("team_id").alias("position"))
    book = identity.alias_book(known).withColumnRenamed("name", "normal")
    return names.join(book, "normal", "left").select("team_id", identity.identity_key(F.col("normal"), F.col("canonical_id")).alias("key"))


def ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time to live for some types, overridden for one, and whether a value is still fresh."""
    ttl = pit.ttl_seconds(F.col("data_type"), {"view": 86_400, "click": 600})
    rows = pit.freshness(observations(spark, sf_dir), OBSERVED_AT, ttl)
    return rows.groupBy("data_type", ttl.alias("ttl"), (F.col("freshness") == "fresh").alias("fresh")).agg(F.count(F.lit(1)).alias("n"))


def lineups_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long line-ups are cut."""
    player = F.struct((F.col("l_linenumber") % 3 != 0).alias("starter"), F.col("l_linenumber").cast("string").alias("jersey"), F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("displayName")).alias("athlete"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", player.alias("p"))
    teams = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("match_id"), (F.col("l_suppkey") % 2).alias("side")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"]).alias("roster"))
    roster = F.struct(F.struct(F.col("side").cast("string").alias("id")).alias("team"), "roster")
    bodies = teams.groupBy("match_id").agg(F.to_json(F.struct(F.collect_list(roster).alias("rosters"))).alias("body"))
    return parsers.lineups(bodies).select("match_id", "team_id", F.array_join("starters", ",").alias("starters"), F.array_join("substitutes", ",").alias("substitutes"))


def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim with a value, of each of the kinds that values have."""
    k = F.col("c_custkey")
    claim = lambda value: F.concat(F.lit('{"mainsnak":{"datavalue":{"value":'), value, F.lit("}}}"))
    value = F.when(k % 4 == 0, F.concat(F.lit('{"id":"Q'), k.cast("string"), F.lit('"}'))).when(k % 4 == 1, F.concat(F.lit('{"amount":"+'), k.cast("string"), F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit('"plain '), k.cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"claims":{"P17":['), claim(value), F.lit(","), claim(F.lit('{"id":"Q0"}')), F.lit('],"P18":[{"mainsnak":{}}]}}'))
    rows = parsers.first_claims(table(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), ["P17", "P18", "P19"])
    return rows.select("c_custkey", "P17", F.coalesce("P18", F.lit("")).alias("P18"), F.coalesce("P19", F.lit("")).alias("P19"))


def weather_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour nearest to a start, the earlier of two."""
    hour = F.col("o_orderdate") - F.make_dt_interval(mins=(F.col("o_orderkey") % 97).cast("int"))
    times = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.date_format(F.date_trunc("hour", hour) + F.make_dt_interval(hours=i), "yyyy-MM-dd'T'HH:mm"))
    hourly = F.struct(times.alias("time"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("o_orderkey") % 30 + i).cast("double")).alias("temperature_2m"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i / 10.0).alias("precipitation"))
    rows = table(spark, sf_dir, "orders").withColumn("body", F.to_json(F.struct(hourly.alias("hourly")))).withColumn("start", F.expr("o_orderdate + make_dt_interval(0, 1, CAST(o_orderkey % 53 AS INT))")).select("o_orderkey", "start", "body")
    return parsers.weather(rows, "start").select("o_orderkey", "slot", "temperature", F.round("precipitation", 4).alias("precipitation"))


def entity_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by an id of a source."""
    k = F.col("l_orderkey")
    entities = table(spark, sf_dir, "lineitem").select(F.lit("team").alias("entity_type"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (F.col("l_partkey") % 500).cast("string").alias("external_id"), (F.col("l_suppkey") % 9).cast("string").alias("internal_key"), F.when(F.col("l_quantity") > 25, "MATCH_AUTO").otherwise("UNKNOWN").alias("status"), F.round(F.col("l_discount") * 9, 2).alias("confidence"))
    asked = table(spark, sf_dir, "part").select(F.lit("team").alias("entity_type"), F.concat(F.lit("s"), (F.col("p_partkey") % 4).cast("string")).alias("source"), (F.col("p_partkey") % 700).cast("string").alias("external_id"), F.col("p_partkey").alias("asked"))
    return identity.entities_of(asked, entities).select("asked", F.coalesce("internal_key", F.lit("")).alias("internal_key"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))


def venue_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the grounds of nations lie, by a part of their name."""
    place = lambda name: [name.alias("name"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country")]
    n = F.col("n_nationkey")
    venues = table(spark, sf_dir, "nation").select(n.cast("string").alias("venue_id"), *place(F.concat(F.lit("National Arena "), F.col("n_name"))), F.when(n % 6 != 0, n * 1.5).alias("latitude"), (-n * 2.0).alias("longitude"))
    asked = table(spark, sf_dir, "nation").select(n.alias("asked_id"), *place(F.when(n % 5 == 0, F.lit("national arena")).otherwise(F.concat(F.lit("arena "), F.lower("n_name")))))
    none = lambda c: F.coalesce(c, F.lit(-999.0)).alias(c)
    return identity.coordinates(asked, venues).select("asked_id", none("latitude"), none("longitude"))


def feed_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event of one source the one of a feed that it is. Without SQL, as likeness of names has none."""
    book = identity.alias_book(spark.createDataFrame([("Team Alpha 1", "t1", 0), ("Alpha One", "t1", 1), ("Team Bravo 2", "t2", 2)], "alias string, canonical_id string, position int"))
    rows = identity.with_canonical(team_events(spark, sf_dir), F.broadcast(book))
    return identity.pick_events(rows.filter("source = 's0'"), rows.filter("source = 's1'")).withColumn("picked", F.coalesce("picked", F.lit(-1)))


def all_sources_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources as landing files, read by their format: the rows of all_sources."""
    path, at = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}", F.lit("2001-08-02")
    one = parsers.datapoints(table(spark, sf_dir, "orders"), ["o_orderkey"], {"status": "o_orderstatus", "price": "o_totalprice"}, "feed", at).withColumnRenamed("o_orderkey", "key")
    two = parsers.datapoints(table(spark, sf_dir, "customer"), ["c_custkey"], {"segment": "c_mktsegment"}, "registry", at).withColumnRenamed("c_custkey", "key")
    landing.land(one.unionByName(two), path)
    rows = landing.landed(spark, path)
    of = lambda s, name: F.count(F.when(F.col("source") == s, F.col("key"))).alias(name)
    return rows.groupBy("source", "data_type").agg(of("feed", "matches"), of("registry", "teams"), F.countDistinct("value").alias("values"))


def stream_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as fixtures with the views of the same user in the six hours after, or none (T-16, T-18)."""
    rows = _stream(spark, sf_dir).withColumn("key", F.col("user_id"))
    told = pipelines.with_details(rows.filter("event_type = 'purchase'").withColumn("match_id", F.col("event_id")), rows.filter("event_type = 'view'").withColumn("detail_id", F.col("event_id")))
    return pipelines.current_details(_drained(spark, told, "append")).select("match_id", F.coalesce("detail_id", F.lit(-1)).alias("detail_id"), "version")


QUERIES = {f.__name__: f for f in (
    page_hosts, parsed_days, agreement_credits, tolerant_seconds, identity_keys, ttl_lookup, lineups_scan, first_claims, weather_slots, entity_reads, venue_coordinates, feed_picks, all_sources_landed, stream_details,
)}
ORACLES = {
    "page_hosts": "SELECT CASE WHEN url LIKE '%://%' THEN split_part(url, '/', 3) ELSE '' END AS host, count(*) AS n FROM pages GROUP BY 1",
    "parsed_days": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day FROM orders",
    "agreement_credits": "WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + to_minutes(CAST(o_orderkey % 3000 AS INTEGER) - 1500) AS b FROM orders) SELECT o_orderkey, CASE abs(date_diff('day', CAST(a AS DATE), CAST(b AS DATE))) WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END AS by_day, CASE WHEN abs(o_orderkey % 3000 - 1500) <= 25 THEN 1e0 WHEN abs(o_orderkey % 3000 - 1500) <= 181 THEN 0.5e0 ELSE 0e0 END AS by_time FROM o",
    "tolerant_seconds": "SELECT event_id, CASE event_id % 5 WHEN 4 THEN -1 ELSE CAST(epoch(date_trunc('minute', ts)) AS BIGINT) + [0, 7, 59, 0][event_id % 5 + 1] END AS \"at\" FROM events",
    "identity_keys": f"WITH n AS (SELECT c_custkey AS team_id, replace(lower({_NAME}), '-', ' ') AS normal FROM customer), b AS (SELECT normal, 't' || arg_min(team_id % 7, team_id) AS id FROM n WHERE team_id % 3 = 0 GROUP BY 1) SELECT team_id, coalesce(id, 'name:' || normal) AS key FROM n LEFT JOIN b USING (normal)",
    "ttl_lookup": f"""WITH {OBSERVATIONS_SQL}, t AS (SELECT data_type, CAST(CASE data_type WHEN 'view' THEN 86400 WHEN 'click' THEN 600 ELSE -1 END AS INTEGER) AS ttl, greatest(0, CAST(epoch(TIMESTAMP '{OBSERVED_AT}') - floor(epoch(retrieved_at)) AS BIGINT)) AS age FROM observations)
SELECT data_type, ttl, ttl >= 0 AND age <= ttl AS fresh, count(*) AS n FROM t GROUP BY 1, 2, 3""",
    "lineups_scan": """WITH l AS (SELECT l_orderkey % 300 AS match_id, CAST(l_suppkey % 2 AS VARCHAR) AS team_id, l_linenumber % 3 <> 0 AS starter, 'P' || l_partkey AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS o FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id, starter ORDER BY o) AS rn FROM l)
SELECT match_id, team_id, coalesce(string_agg(p, ',' ORDER BY o) FILTER (WHERE starter AND rn <= 11), '') AS starters, coalesce(string_agg(p, ',' ORDER BY o) FILTER (WHERE NOT starter AND rn <= 12), '') AS substitutes FROM r GROUP BY 1, 2""",
    "first_claims": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Q' || c_custkey WHEN 1 THEN '+' || c_custkey WHEN 2 THEN 'plain ' || c_custkey ELSE 'Q0' END AS P17, '' AS P18, '' AS P19 FROM customer",
    "weather_slots": """WITH o AS (SELECT o_orderkey, date_trunc('hour', o_orderdate - to_minutes(CAST(o_orderkey % 97 AS INTEGER))) AS h, o_orderdate + to_hours(1) + to_minutes(CAST(o_orderkey % 53 AS INTEGER)) AS s FROM orders),
x AS (SELECT o_orderkey, i, h + to_hours(CAST(i AS INTEGER)) AS t, abs(epoch(h) + 3600 * i - floor(epoch(s))) AS off FROM o, range(6) r(i))
SELECT o_orderkey, strftime(t, '%Y-%m-%dT%H:%M') AS slot, CAST(o_orderkey % 30 + i AS DOUBLE) AS temperature, round(i / 10e0, 4) AS precipitation FROM x QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY off, t) = 1""",
    "entity_reads": """WITH e AS (SELECT 's' || (l_orderkey % 3) AS source, l_partkey % 500 AS id, CAST(l_suppkey % 9 AS VARCHAR) AS k, round(l_discount * 9, 2) AS c FROM lineitem), b AS (SELECT source, id, max(c) AS c FROM e GROUP BY 1, 2), w AS (SELECT source, id, c, min(k) AS k FROM e JOIN b USING (source, id, c) GROUP BY 1, 2, 3)
SELECT p_partkey AS asked, coalesce(k, '') AS internal_key, coalesce(c, -1e0) AS confidence FROM part LEFT JOIN w ON w.source = 's' || (p_partkey % 4) AND w.id = p_partkey % 700""",
    "venue_coordinates": """WITH v AS (SELECT n_nationkey AS k, 'national arena ' || lower(n_name) AS name FROM nation WHERE n_nationkey % 6 <> 0), a AS (SELECT n_nationkey AS asked_id, CASE WHEN n_nationkey % 5 = 0 THEN 'national arena' ELSE 'arena ' || lower(n_name) END AS name FROM nation),
m AS (SELECT asked_id, count(*) AS n, min(k) AS k FROM a JOIN v ON contains(v.name, a.name) GROUP BY 1)
SELECT asked_id, coalesce(CASE WHEN n = 1 THEN k * 1.5e0 END, -999e0) AS latitude, coalesce(CASE WHEN n = 1 THEN -k * 2e0 END, -999e0) AS longitude FROM a LEFT JOIN m USING (asked_id)""",
    "stream_details": """WITH f AS (SELECT user_id, event_id AS match_id, ts AS kickoff FROM events WHERE event_type = 'purchase'), d AS (SELECT user_id, event_id AS detail_id, ts FROM events WHERE event_type = 'view'),
w AS (SELECT least((SELECT max(kickoff) FROM f), (SELECT max(ts) FROM d)) - INTERVAL 1 DAY AS mark),
m AS (SELECT match_id, kickoff, max(row(d.ts, detail_id)) FILTER (WHERE detail_id IS NOT NULL) AS last, count(DISTINCT detail_id) AS version FROM f LEFT JOIN d ON d.user_id = f.user_id AND d.ts BETWEEN kickoff AND kickoff + INTERVAL 6 HOUR GROUP BY 1, 2)
SELECT match_id, coalesce(last[2], -1) AS detail_id, version FROM m, w WHERE version > 0 OR kickoff + INTERVAL 6 HOUR < mark""",
}
