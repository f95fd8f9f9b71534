"""Queries of names, identity, feeds and streams, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions import numbers, text, time
from foretide.operators import identity, ledger
from foretide.plans.views import table
from foretide.sources import access, parsers
from foretide.streaming import pipelines
from foretide.streaming.scratch import shared_folder
from foretide.streaming.stateful import state_by_key


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers and parts as team names, with tokens to drop."""
    k = F.col("c_custkey")
    suffix = F.element_at(F.array(*map(F.lit, (" FC", " Women", " U19", "-United", " Academy", " Club"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("team_id"), F.concat(F.initcap("c_mktsegment"), F.lit(" "), (k % 40).cast("string"), suffix).alias("name"))


def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normal_name(F.col("name"))
    return _names(spark, sf_dir).select("team_id", n.alias("normal"), text.compact_name(F.col("name")).alias("compact"), text.without_club_tokens(n).alias("base"), text.category(n).alias("category"))


def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    label = F.concat("name", F.when(F.col("team_id") % 3 == 0, " vs ").when(F.col("team_id") % 3 == 1, " v ").otherwise(" - "), F.lit("Villa Nova"))
    return names.select("team_id", text.split_sides(label).alias("s")).select("team_id", F.coalesce("s.home", F.lit("")).alias("home"), F.coalesce("s.away", F.lit("")).alias("away"))


def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    status = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, " Postponed").otherwise(" played"))
    return rows.select("o_orderkey", time.season_code(F.col("day")).alias("season"), text.fallback_key(F.col("o_orderpriority"), F.col("o_orderdate"), F.lit("a"), F.lit("b")).alias("key"), text.short_hash(F.col("o_orderpriority")).alias("short"), text.cancelled(status).alias("off"), text.canonical_match_id(F.col("o_orderpriority"), F.col("day"), F.lit("h"), F.lit("a")).alias("canonical"))


def parsed_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    raw = F.when(k % 4 == 0, F.concat(iso, F.lit("Z"))).when(k % 4 == 1, F.concat(iso, F.lit(":30Z"))).when(k % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(time.parse_instant(raw)).alias("at"), time.is_iso(raw).alias("iso")).withColumn("at", F.coalesce("at", F.lit(-1)))


def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.concat((k % 500).cast("string"), F.lit(".5"))).when(k % 3 == 1, F.concat(F.lit("-"), (k % 300 + 100).cast("string"))).otherwise("n/a")
    none = lambda c: F.coalesce(c, F.lit(-999999.0))
    return table(spark, sf_dir, "events").select("event_id", none(numbers.safe_int(raw).cast("double")).alias("whole"), none(F.round(numbers.american_probability(raw), 6)).alias("p"), none(numbers.american_decimal(raw)).alias("decimal"))


def url_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages may be read, by a registry of two sources; their address is the least host of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 5 == 0, "none").when(F.col("page_id") % 5 == 1, "off").otherwise("on").alias("source_id"))
    found = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?", "http")).otherwise(F.regexp_replace("url", "^https?", "https"))
    base = pages.agg(F.min(F.concat(F.lit("https://"), F.try_parse_url("url", F.lit("HOST")))).alias("base_url"))
    registry = spark.createDataFrame([("on", True, "active"), ("off", False, "active")], "source_id string, enabled boolean, status string").crossJoin(base)
    return access.access(pages.withColumn("url", found), registry).select("page_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"))


def team_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures as two sources tell them: names differ by suffixes and accents, some starts by minutes or days."""
    k = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("Team "), F.element_at(F.array(*map(F.lit, ("Alpha", "Bravo", "Carlo", "Delta", "Echo"))), (F.col(c) % 5 + 1).cast("int")), F.lit(" "), (F.col(c) % 97).cast("string"))
    rows = table(spark, sf_dir, "orders").withColumn("other", F.col("o_custkey") + 1 + k % 13)
    one = rows.select((k * 2).alias("event_id"), F.lit("s0").alias("source"), k.cast("string").alias("external_id"), name("o_custkey").alias("home"), name("other").alias("away"), F.col("o_orderpriority").alias("competition"), F.col("o_orderdate").alias("kickoff"), F.lit(None).cast("string").alias("venue"))
    late = F.when(k % 10 == 0, 24 * 60).when(k % 10 == 1, 100).when(k % 10 == 2, 3 * 24 * 60).otherwise(10)
    two = rows.select((k * 2 + 1).alias("event_id"), F.lit("s1").alias("source"), (k + 5).cast("string").alias("external_id"), F.concat(name("o_custkey"), F.lit(" FC")).alias("home"), F.concat(name("other"), F.when(k % 9 == 0, " Women").otherwise("")).alias("away"), F.col("o_orderpriority").alias("competition"), (F.col("o_orderdate") + F.make_dt_interval(mins=late)).alias("kickoff"), F.lit(None).cast("string").alias("venue"))
    return one.unionByName(two)


def _compared(spark: SparkSession, sf_dir: str, fit: bool = False) -> DataFrame:
    book = identity.alias_book(spark.createDataFrame([("Team Alpha 1", "t1", 0), ("Alpha One", "t1", 1), ("Team Bravo 2", "t2", 2)], "alias string, canonical_id string, position int"))
    rows = identity.with_canonical(team_events(spark, sf_dir), F.broadcast(book))
    return identity.compare(identity.candidates(rows.filter("source = 's0'"), rows.filter("source = 's1'"), fit))


def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("a_event_id", "b_event_id", "confidence", "status", "reason")


def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve(_compared(spark, sf_dir, fit=True)).withColumn("b_event_id", F.coalesce("b_event_id", F.lit(-1)))


def identity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the decision that needs no likeness of names: pairs of the same fixture whose names agree."""
    same = F.col("b_event_id") == F.col("a_event_id") + 1
    return identity_scores(spark, sf_dir).filter(same & ~F.col("status").isin("NO_MATCH")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def entity_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(F.lit("team").alias("entity_type"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (F.col("l_partkey") % 500).alias("external_id"), (F.col("l_partkey") % 500 + F.when(k % 1000 == 0, 1).otherwise(0)).alias("entity_id"), F.round(0.7 + F.col("l_discount") * 3, 4).alias("confidence"))
    return identity.propose_entities(rows).select("source", "external_id", "entities", "entity_id", F.round("confidence", 4).alias("confidence"), "status")


def prefix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of parts' types meet the only full form they begin."""
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("known_name")).distinct()
    short = table(spark, sf_dir, "part").select(F.lower(F.substring("p_type", 1, 9)).alias("name")).distinct()
    return identity.unique_prefix_join(short, types)


def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of bodies in long form, and how many bodies can't be read."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("body"))
    keys = parsers.properties(rows).groupBy("readable", F.coalesce("key", F.lit("")).alias("key"))
    return keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("number"), F.lit(0.0)).alias("total"), F.countDistinct("value").alias("values"))


def datapoints_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("note", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")))
    out = parsers.datapoints(rows, ["o_orderkey"], {"status": "o_orderstatus", "note": "note"}, "feed", F.lit("2001-08-02"))
    return out.groupBy("data_type", "value", "source", "retrieved_at").agg(F.count(F.lit(1)).alias("n"))


def unknown_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"), F.col("event_type").alias("data_type"))
    missing = parsers.expected_but_missing(points.filter("data_type <> 'error' OR match_id % 2 = 0"), points.select("match_id").distinct(), ["error", "lineups"])
    return missing.select("match_id", "data_type")


def request_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("match_id"), F.col("c_nationkey").alias("league"))
    return parsers.requests(matches, {"a": "https://a.example/{league}/{match_id}", "b": "https://b.example/m?id={match_id}"})


def price_band_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price band of each part over time: a band that comes back makes no new version (T-02, W11)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("band", F.floor(F.col("l_extendedprice") / 20000).cast("string"))
    out = ledger.versions(rows, "l_partkey", ["l_shipdate", "l_orderkey"], F.col("band"))
    return out.select("l_partkey", F.col("hash").alias("band"), "version_seq")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return pipelines.source(spark, path, spark.read.parquet(path).schema)


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over all files there are gives; kept in the shared folder that the session names."""
    root = shared_folder(spark)
    to, kept = f"{root}/stream-{uuid.uuid4().hex}", []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/out/batch={number}")
        kept.append(number)

    pipelines.run_batches(stream, each, f"{to}/checkpoint", mode)
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{to}/out/batch={n}" for n in kept])


def stream_daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(spark, pipelines.windowed_counts(_stream(spark, sf_dir)), "update")
    last = out.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "x.n", "x.total")


def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")
    return _drained(spark, pipelines.exactly_once(rows, ["event_id"]), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_change_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    with state_by_key(spark):
        return _drained(spark, pipelines.changes(_stream(spark, sf_dir).filter("value IS NOT NULL")), "append").select("user_id", "event_id", "fingerprint", "version")


def stream_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is pushed of each user's events: changes alone, for nothing is quiet long enough for a sign of life."""
    with state_by_key(spark):
        return _drained(spark, pipelines.pushed(_stream(spark, sf_dir)), "append").select("user_id", "event_id", "content", "kind", "beat")


def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir)
    return _drained(spark, pipelines.joined_within(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), "user_id", "6 hours"), "append").select("key", "left_id", "right_id")


_NAME = "(upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || (c_custkey % 40) || [' FC', ' Women', ' U19', '-United', ' Academy', ' Club'][c_custkey % 6 + 1])"
QUERIES = {f.__name__: f for f in (
    normalized_names, split_labels, scalar_texts, parsed_instants, safe_casts, url_access, identity_scores, identity_resolve, identity_exact, entity_proposals, prefix_names, json_properties, datapoints_long,
    unknown_coverage, request_list, price_band_versions, stream_daily_event_counts, stream_exactly_once, stream_change_versions, stream_pushes, stream_joined,
)}
ORACLES = {
    "normalized_names": f"WITH n AS (SELECT c_custkey AS team_id, lower({_NAME}) AS l FROM customer), m AS (SELECT team_id, replace(l, '-', ' ') AS normal, replace(replace(l, ' ', ''), '-', '') AS compact FROM n) SELECT team_id, normal, compact, regexp_replace(regexp_replace(normal, ' fc$', ''), ' club$', '') AS base, CASE WHEN normal LIKE '% women' THEN 'women' WHEN normal LIKE '% u19' THEN 'u19' WHEN normal LIKE '% academy' THEN 'youth' ELSE 'open' END AS category FROM m",
    "split_labels": f"SELECT c_custkey AS team_id, CASE WHEN c_custkey % 3 < 2 THEN {_NAME} ELSE '' END AS home, CASE WHEN c_custkey % 3 < 2 THEN 'Villa Nova' ELSE '' END AS away FROM customer",
    "scalar_texts": "WITH o AS (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y FROM orders) SELECT o_orderkey, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, o_orderpriority || '|' || strftime(o_orderdate, '%Y%m%d%H') || '|a|b' AS key, substr(sha256(o_orderpriority), 1, 16) AS short, o_orderkey % 7 = 0 AS off, 'match:' || o_orderpriority || '|' || CAST(o_orderdate AS DATE) || '|h|a' AS canonical FROM o",
    "parsed_instants": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) + 30 WHEN 2 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) ELSE -1 END AS \"at\", event_id % 4 <> 3 AS iso FROM events",
    "safe_casts": "WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 500 + 0.5e0 WHEN 1 THEN -(event_id % 300 + 100)::DOUBLE END AS x FROM events) SELECT event_id, coalesce(trunc(x), -999999) AS whole, coalesce(round(CASE WHEN x > 0 THEN 100 / (x + 100) WHEN x < 0 THEN -x / (100 - x) END, 6), -999999) AS p, coalesce(round(CASE WHEN x > 0 THEN 1 + x / 100 WHEN x < 0 THEN 1 - 100 / x END, 3), -999999) AS decimal FROM r",
    "url_access": """WITH p AS (SELECT page_id, split_part(url, '/', 3) AS host FROM pages), b AS (SELECT min(host) AS base FROM p),
r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'UNKNOWN_SOURCE' WHEN page_id % 5 = 1 THEN 'SOURCE_DISABLED' WHEN page_id % 7 = 0 THEN 'NOT_HTTPS'
  WHEN host <> base AND host <> CASE WHEN starts_with(base, 'www.') THEN substr(base, 5) ELSE 'www.' || base END THEN 'HOST_NOT_LISTED' ELSE '' END AS reason FROM p, b)
SELECT page_id, CASE reason WHEN '' THEN 'ALLOW' WHEN 'UNKNOWN_SOURCE' THEN 'UNKNOWN' ELSE 'DENY' END AS decision, reason FROM r""",
    "identity_exact": "WITH p AS (SELECT CASE o_orderkey % 10 WHEN 0 THEN 0.64e0 WHEN 1 THEN 0.755e0 ELSE 0.8e0 END AS c FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 2) SELECT CASE WHEN c >= 0.8e0 THEN 'MATCH_JOURNALIZED' ELSE 'UNKNOWN' END AS status, count(*) AS n, round(avg(c), 4) AS confidence FROM p GROUP BY 1",
    "entity_proposals": "WITH r AS (SELECT 's' || (l_orderkey % 3) AS source, l_partkey % 500 AS external_id, l_partkey % 500 + CASE WHEN l_orderkey % 1000 = 0 THEN 1 ELSE 0 END AS entity_id, round(0.7e0 + l_discount * 3, 4) AS confidence FROM lineitem), g AS (SELECT source, external_id, count(DISTINCT entity_id) AS entities, min(entity_id) AS entity_id, round(max(confidence), 4) AS confidence FROM r WHERE confidence >= 0.80e0 GROUP BY 1, 2) SELECT *, CASE WHEN entities > 1 THEN 'REFUSED' WHEN confidence >= 0.95e0 THEN 'MATCH_AUTO' ELSE 'MATCH_JOURNALIZED' END AS status FROM g",
    "prefix_names": "WITH k AS (SELECT DISTINCT lower(p_type) AS known_name FROM part), s AS (SELECT DISTINCT lower(substr(p_type, 1, 9)) AS name FROM part), m AS (SELECT name, max(known_name) FILTER (WHERE name = known_name) AS eq, count(DISTINCT known_name) AS n, min(known_name) AS one FROM s JOIN k ON starts_with(known_name, name) OR starts_with(name, known_name) GROUP BY name) SELECT name, coalesce(eq, one) AS known_name FROM m WHERE eq IS NOT NULL OR n = 1",
    "json_properties": """WITH b AS (SELECT event_id, props, event_id % 50 <> 0 AND props IS NOT NULL AND json_valid(props) AS readable FROM events), k AS (SELECT readable, unnest(json_keys(props)) AS key, props FROM b WHERE readable),
v AS (SELECT readable, key, json_extract_string(props, '$."' || key || '"') AS value FROM k UNION ALL SELECT false, '', NULL FROM b WHERE NOT readable)
SELECT readable, key, count(*) AS n, coalesce(sum(TRY_CAST(value AS DOUBLE)), 0) AS total, count(DISTINCT value) AS "values" FROM v GROUP BY 1, 2""",
    "datapoints_long": "SELECT data_type, value, 'feed' AS source, '2001-08-02' AS retrieved_at, count(*) AS n FROM (SELECT 'status' AS data_type, o_orderstatus AS value FROM orders UNION ALL SELECT 'note', o_orderpriority FROM orders WHERE o_orderkey % 4 = 0) GROUP BY 1, 2",
    "unknown_coverage": "WITH m AS (SELECT DISTINCT user_id AS match_id FROM events) SELECT match_id, 'lineups' AS data_type FROM m UNION ALL SELECT match_id, 'error' FROM m WHERE match_id % 2 = 1 OR match_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "request_list": "SELECT c_custkey AS match_id, 'a' AS source, 'https://a.example/' || c_nationkey || '/' || c_custkey AS url FROM customer UNION ALL SELECT c_custkey, 'b', 'https://b.example/m?id=' || c_custkey FROM customer",
    "price_band_versions": "WITH f AS (SELECT l_partkey, CAST(CAST(floor(l_extendedprice / 20000) AS BIGINT) AS VARCHAR) AS band, min(row(l_shipdate, l_orderkey)) AS first FROM lineitem GROUP BY 1, 2) SELECT l_partkey, band, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY first, band) AS INTEGER) AS version_seq FROM f",
    "stream_daily_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_exactly_once": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_change_versions": "WITH e AS (SELECT *, event_type || '|' || CAST(floor(value / 50) AS BIGINT) AS fingerprint FROM events WHERE value IS NOT NULL), f AS (SELECT user_id, event_id, ts, fingerprint FROM e QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY ts, event_id) = 1) SELECT user_id, event_id, fingerprint, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM f",
    "stream_pushes": "WITH e AS (SELECT *, concat_ws('|', event_type, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)) AS content FROM events), p AS (SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e) SELECT user_id, event_id, content, 'change' AS kind, 0 AS beat FROM p WHERE content IS DISTINCT FROM before",
    "stream_joined": "SELECT a.user_id AS key, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'",
}
