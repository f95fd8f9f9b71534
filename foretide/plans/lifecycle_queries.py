"""Queries of the life of forecasts, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.operators import lifecycle, rating
from foretide.plans.ledger_queries import PUBLISHED_SQL, publications
from foretide.plans.views import reused, table


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publications(spark, sf_dir)
    present = {"odds": F.col("match_id") % 3 != 0, "lineups": F.col("match_id") % 4 == 0}
    return lifecycle.snapshots(rows, ["competition", "odds"], ["p1", "px", "p2"], present, (F.col("match_id") % 10) / 10)


def snapshot_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different payloads a fixture's three versions have: equal forecasts are equal texts."""
    fields = F.first(F.array_join("available", ",")).alias("fields")
    return _snapshots(spark, sf_dir).groupBy("match_id").agg(F.countDistinct("payload_hash").alias("payloads"), fields, F.first("completeness").alias("completeness"))


def reference_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.reference_marks(publications(spark, sf_dir))


def _marks(offers: DataFrame) -> DataFrame:
    """Marks as a log may hold them: not for all fixtures."""
    return lifecycle.reference_marks(offers).filter(F.col("match_id") % 6 != 0)


def evaluation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the marked versions, and of the last ones in time where there is no mark."""
    offers = reused(publications(spark, sf_dir))
    rows = lifecycle.evaluation_feed(offers, _marks(offers), rating.market_families(offers, "version_seq"))
    return rows.select("match_id", "version_seq", "family", "selection")


def _endings(offers: DataFrame) -> DataFrame:
    """How fixtures ended: some are off, lack a score or an official end, or were final before."""
    once = offers.filter("version_seq = 1")
    matches = once.select(
        "match_id", F.when(F.col("match_id") % 31 == 0, "in").otherwise("post").alias("state"), (F.col("match_id") % 23 != 0).alias("completed"), F.when(F.col("match_id") % 19 != 0, F.col("hg")).alias("hg"), "ag",
        F.when(F.col("src_status") == "P", "Match Postponed").otherwise("FT").alias("detail"), F.when(F.col("match_id") % 29 == 0, "VOID").alias("evaluation_status"),
    )
    return lifecycle.endings(matches, lifecycle.evaluation_versions(offers, _marks(offers)).filter(F.col("match_id") % 7 != 0))


def match_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endings(reused(publications(spark, sf_dir))).select("match_id", F.coalesce("evaluation_status", F.lit("")).alias("evaluation_status"), "is_new")


def settlement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = reused(publications(spark, sf_dir))
    counted = lifecycle.evaluation_feed(offers, _marks(offers), rating.market_families(offers, "version_seq"))
    return lifecycle.settled_rows(_endings(offers), counted).select("match_id", "version_seq", "family", "outcome", "won", "brier", "logloss")


def row_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by status and version: void are those of the latest version only."""
    offers = reused(publications(spark, sf_dir))
    rows = rating.market_families(offers, "version_seq").withColumn("status", F.when(F.col("match_id") % 37 == 0, "WITHDRAWN").otherwise("PREDICTION_FROZEN"))
    ended = _endings(offers)
    counted = lifecycle.evaluation_feed(offers, _marks(offers), rows.drop("status"))
    out = lifecycle.statuses(rows, ended, lifecycle.settled_rows(ended, counted))
    return out.groupBy("status", "version_seq").agg(F.count(F.lit(1)).alias("n"))


def frozen_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = reused(_snapshots(spark, sf_dir))
    out = lifecycle.display(held, lifecycle.evaluation_versions(held, _marks(held)), "p1:DOUBLE,px:DOUBLE,p2:DOUBLE", "model 1")
    return out.select("match_id", "version_seq", "frozen", *[F.round(f"output.{c}", 6).alias(c) for c in ("p1", "px", "p2")])


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = reused(publications(spark, sf_dir))
    counted = lifecycle.evaluation_feed(offers, _marks(offers), rating.market_families(offers, "version_seq"))
    return lifecycle.verdict_rows(lifecycle.settled_rows(_endings(offers), counted))


def ledger_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rating.market_families(publications(spark, sf_dir), "version_seq")
    return lifecycle.versions_in_order(rows).filter("place % 6 = 1").select("match_id", "place", "version_seq", "family")


def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.counts_by_reference(publications(spark, sf_dir).filter("version_seq > 1 OR match_id % 2 = 0"))


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model's versions the active one; what comes again changes nothing."""
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), (k % 50).alias("version"), "o_orderdate").agg(F.min(k).alias("k"))
    retired = F.when(F.col("version") % 3 == 0, F.col("o_orderdate"))
    found = lifecycle.registered_models(rows.select("name", "version", F.concat(F.lit("c"), F.col("k").cast("string")).alias("configuration"), F.col("o_orderdate").alias("registered_at"), retired.alias("retired_at")))
    return lifecycle.active_models(found).select("name", "version", "active_from", "configuration_hash")


QUERIES = {f.__name__: f for f in (
    snapshot_payloads, reference_marks, evaluation_feed, match_endings, settlement_rows, row_statuses, frozen_display, verdict_rows, ledger_in_order, reference_kinds, model_registry,
)}

_LIFE = PUBLISHED_SQL + """,
marks AS (SELECT match_id, arg_max(version_seq, row(frozen_at, version_seq)) AS version_seq FROM offers WHERE frozen_at <= kickoff - INTERVAL 15 MINUTE GROUP BY match_id),
logged AS (SELECT * FROM marks WHERE match_id % 6 <> 0),
chosen AS (SELECT o.match_id, coalesce(max(o.version_seq) FILTER (WHERE o.version_seq = l.version_seq), max(o.version_seq)) AS version_seq
  FROM offers o LEFT JOIN logged l ON l.match_id = o.match_id WHERE frozen_at <= kickoff GROUP BY o.match_id),
ends AS (SELECT match_id, CASE WHEN match_id % 19 <> 0 THEN hg END AS hg, ag, CASE WHEN match_id % 31 = 0 THEN CASE WHEN match_id % 29 = 0 THEN 'VOID' ELSE '' END
    WHEN match_id % 29 = 0 THEN 'VOID' WHEN src_status = 'P' THEN 'VOID' WHEN match_id % 23 = 0 OR match_id % 19 = 0 THEN ''
    WHEN match_id % 7 <> 0 AND match_id IN (SELECT match_id FROM chosen) THEN 'SETTLED' ELSE 'NOT_EVALUABLE' END AS evaluation_status FROM offers WHERE version_seq = 1),
final AS (SELECT s.*, k.family, k.selection, k.p, e.ag AS a2 FROM chosen s JOIN ends e ON e.match_id = s.match_id AND e.evaluation_status = 'SETTLED'
  JOIN picks k ON k.match_id = s.match_id AND k.version_seq = s.version_seq),
paid AS (SELECT x.* FROM final f JOIN everything x ON x.match_id = f.match_id AND x.version_seq = f.version_seq AND x.family = f.family)"""
ORACLES = {
    "snapshot_payloads": PUBLISHED_SQL + " SELECT match_id, count(DISTINCT (p1, px, p2)) AS payloads, 'team_stats,league_avgs' || CASE WHEN match_id % 3 <> 0 THEN ',odds' ELSE '' END || CASE WHEN match_id % 4 = 0 THEN ',lineups' ELSE '' END AS fields, CASE WHEN match_id % 10 >= 6 THEN 'full' ELSE 'partial' END AS completeness FROM offers GROUP BY match_id",
    "reference_marks": _LIFE + " SELECT match_id, version_seq, 't15_reference' AS kind FROM marks",
    "evaluation_feed": _LIFE + " SELECT k.match_id, k.version_seq, family, selection FROM picks k JOIN chosen c ON c.match_id = k.match_id AND c.version_seq = k.version_seq",
    "match_endings": _LIFE + " SELECT match_id, evaluation_status, evaluation_status <> '' AND match_id % 29 <> 0 AS is_new FROM ends",
    "settlement_rows": _LIFE + " SELECT match_id, version_seq, family, outcome, won, round(brier, 6) AS brier, round(logloss, 6) AS logloss FROM paid",
    "row_statuses": _LIFE + """, st AS (SELECT k.version_seq, CASE WHEN p.match_id IS NOT NULL THEN 'SETTLED' WHEN k.match_id % 37 = 0 THEN 'WITHDRAWN' WHEN e.evaluation_status = 'VOID' AND k.version_seq = 3 THEN 'VOID' ELSE 'PREDICTION_FROZEN' END AS status
      FROM picks k LEFT JOIN ends e ON e.match_id = k.match_id LEFT JOIN paid p ON p.match_id = k.match_id AND p.version_seq = k.version_seq AND p.family = k.family) SELECT status, version_seq, count(*) AS n FROM st GROUP BY ALL""",
    "frozen_display": _LIFE + " SELECT o.match_id, o.version_seq, true AS frozen, round(p1, 6) AS p1, round(px, 6) AS px, round(p2, 6) AS p2 FROM offers o JOIN chosen c ON c.match_id = o.match_id AND c.version_seq = o.version_seq",
    "verdict_rows": _LIFE + """, sure AS (SELECT * FROM paid QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY p DESC, family) = 1)
      SELECT s.match_id, t.outcome AS real, s.hg || '-' || s.ag AS score, t.selection AS pick, t.selection = t.outcome AS pick_ok, s.family || ' · ' || s.selection AS safe_label, round(s.p * 100, 1) AS safe_p, s.won AS safe_ok
      FROM sure s JOIN paid t ON t.match_id = s.match_id AND t.family = '1N2'""",
    "ledger_in_order": PUBLISHED_SQL + ", o AS (SELECT match_id, version_seq, family, CAST(row_number() OVER (PARTITION BY match_id ORDER BY version_seq, family) AS INTEGER) AS place FROM picks) SELECT * FROM o WHERE place % 6 = 1",
    "reference_kinds": PUBLISHED_SQL + ", h AS (SELECT match_id, bool_or(frozen_at <= kickoff - INTERVAL 15 MINUTE) AS m, bool_or(frozen_at <= kickoff) AS l FROM offers WHERE version_seq > 1 OR match_id % 2 = 0 GROUP BY match_id) SELECT CASE WHEN m THEN 'mark' WHEN l THEN 'last' ELSE 'none' END AS kind, count(*) AS n FROM h GROUP BY 1",
    "model_registry": """WITH r AS (SELECT o_orderpriority AS name, o_custkey % 50 AS version, o_orderdate AS t, min(o_custkey) AS k FROM orders GROUP BY ALL),
      f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY name, version ORDER BY t) = 1)
      SELECT name, version, t AS active_from, substr(sha256('c' || k), 1, 16) AS configuration_hash FROM f WHERE version % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY t DESC, version DESC) = 1""",
}
