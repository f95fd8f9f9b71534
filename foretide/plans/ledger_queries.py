"""Queries of the ledger and its evaluation, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.operators import evaluation, ledger, rating
from foretide.plans.rating_queries import BLEND_SQL, forecast, r6, with_odds
from foretide.plans.views import FIXTURES_SQL, FORECAST_DAY, fixtures, reused, table

_P = ("p1", "px", "p2", "over15", "over25", "over35", "btts")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three offers of each forecast: the model's, the blend's, the model's again; some of the last come too late."""
    model = with_odds(forecast(spark, sf_dir)).drop("cells").withColumn("odds", F.round(1.5 + (F.col("match_id") % 17) / 10.0, 2))
    own = ("p1", "px", "p2")
    three = model.withColumns({f"m_{c}": F.col(c) for c in own})
    three = rating.blended(three).withColumn("version_seq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    late = F.when(F.col("match_id") % 17 == 0, 5).otherwise(-10)
    minutes = F.when(F.col("version_seq") == 1, -180).when(F.col("version_seq") == 2, F.when(F.col("match_id") % 5 == 0, -12).otherwise(-60)).otherwise(late)
    rows = three.withColumns({c: F.when(F.col("version_seq") == 2, F.col(c)).otherwise(F.col(f"m_{c}")) for c in own})
    rows = rows.withColumn("frozen_at", F.col("kickoff") + F.make_dt_interval(mins=minutes.cast("int")))
    return rows.select("match_id", "competition", "kickoff", "src_status", "hg", "ag", "odds", "version_seq", "frozen_at", *_P)


def settled(spark: SparkSession, sf_dir: str, reference_only: bool = True) -> DataFrame:
    """Settled rows of the versions that count; fixtures in status P are void."""
    offers = reused(publications(spark, sf_dir)) if reference_only else publications(spark, sf_dir)
    rows = offers.filter("src_status <> 'P'")
    if reference_only:
        rows = rows.join(ledger.reference_version(offers), ["match_id", "version_seq"])
    return ledger.settle(rating.market_families(rows, "competition", "kickoff", "version_seq", "frozen_at", "odds", "hg", "ag"))


def settle_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, sf_dir, False).select("match_id", "version_seq", "family", "selection", "outcome", "won", *r6("p", "brier", "logloss"))


def market_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scoreboard(settled(spark, sf_dir), "family")


def competition_scoreboard_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scoreboard(settled(spark, sf_dir), "competition").orderBy(F.desc("n"), "competition").limit(12)


def model_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scoreboard(settled(spark, sf_dir, False), "version_seq").drop("logloss")


def headline_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.headline(settled(spark, sf_dir))


def safest_pick_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.safest_accuracy(settled(spark, sf_dir))


def roi_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roi(evaluation.profit(settled(spark, sf_dir)))


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.drawdown(evaluation.profit(settled(spark, sf_dir)), ["competition"], ["frozen_at", "match_id"])


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(settled(spark, sf_dir), "p", F.col("won"))


def quality_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    rows = labels.join(docs, "doc_id").withColumn("p", (F.col("doc_id") * 7 + F.col("n_chars")) % 100 / 100.0)
    return evaluation.calibration(rows, "p", F.col("quality") == 1)


def evaluation_reference_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.reference_version(publications(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verdicts(settled(spark, sf_dir))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 600 rows first, then the filters, then the page."""
    rows = publications(spark, sf_dir)
    rows = rating.market_families(rows, "competition", "src_status", "version_seq", "frozen_at", "hg", "ag")
    rows = rows.orderBy(F.desc("frozen_at"), "match_id", "version_seq", "family").limit(600)
    is_won = F.when(F.col("src_status") == "F", ledger.won(F.col("family"), F.col("selection"), F.col("hg"), F.col("ag")))
    rows = rows.withColumn("status", ledger.status(is_won, F.col("src_status") == "P")).filter("family IN ('1N2', 'BTTS') AND status <> 'VOID'")
    return rows.orderBy(F.desc("frozen_at"), "match_id", "version_seq", "family").offset(20).limit(50).select("match_id", "version_seq", "family", "selection", "status")


def match_history_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of a fixture with their selections, as one text."""
    rows = rating.market_families(publications(spark, sf_dir), "version_seq")
    picks = rows.groupBy("match_id", "version_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "selection"))), lambda x: F.concat_ws("=", x["family"], x["selection"])), ",").alias("picks"))
    tree = F.transform(F.array_sort(F.collect_list(F.struct("version_seq", "picks"))), lambda x: F.concat_ws(":", x["version_seq"].cast("string"), x["picks"]))
    return picks.groupBy("match_id").agg(F.count(F.lit(1)).alias("versions"), F.array_join(tree, ";").alias("tree"))


def version_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of each user's state, made of the kind of event and the size of its value."""
    rows = table(spark, sf_dir, "events").withColumn("size", F.floor(F.col("value") / 50).cast("long"))
    out = ledger.versions(rows, "user_id", ["ts", "event_id"], F.sha2(F.concat_ws("|", "event_type", F.coalesce(F.col("size"), F.lit(-1)).cast("string")), 256))
    return out.select("user_id", "hash", "event_id", "version_seq", F.coalesce("replaces", F.lit(0)).alias("replaces"))


def late_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many offers of each version came in time, and how many were refused (T-05, A19, A20)."""
    rows = publications(spark, sf_dir)
    kept = ledger.not_late(rows).groupBy("competition").agg(F.count(F.lit(1)).alias("kept"), F.max("version_seq").alias("last_version"))
    return rows.groupBy("competition").agg(F.count(F.lit(1)).alias("offered")).join(kept, "competition")


def upsert_merge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known scores and venues survive updates without them."""
    rows = fixtures(spark, sf_dir).withColumn("venue", F.concat(F.lit("v"), F.col("home_id").cast("string")))
    stored = rows.filter("match_id % 3 <> 0").select("match_id", F.when(F.col("hg") > 0, F.col("hg")).alias("hg"), "venue")
    incoming = rows.filter("match_id % 2 = 0").select("match_id", F.when(F.col("ag") > 1, F.col("ag") + 10).alias("hg"), F.when(F.col("match_id") % 4 == 0, "").otherwise("new").alias("venue")).withColumn("seen", F.lit(1))
    stored = stored.withColumn("seen", F.lit(0))
    return ledger.merge_upsert(stored, incoming, "match_id", "seen", ["hg", "venue"]).select("match_id", F.col("hg").cast("double").alias("hg"), "venue")


def insert_once_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes not captured in the two days before (by line): the first of each order and part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    fresh = ledger.insert_once(lines.filter("l_suppkey % 2 = 0"), lines.filter("l_suppkey % 2 = 1"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return fresh.select("l_orderkey", "l_linenumber", "l_partkey")


def immutability_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    new = old.filter(k % 101 != 0).withColumns({"c_nationkey": F.when(k % 97 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), "c_mktsegment": F.when(k % 194 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))})
    return ledger.immutability_violations(old, new, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is not among the finished ones, by their order's key."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return ledger.missing_parents(lines, done, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


def price_history_latest3(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    order = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_suppkey"), F.desc("l_extendedprice")]
    return ledger.latest(lines, ["l_partkey"], order, 3).select("l_partkey", "rank", "l_orderkey", F.round("l_extendedprice", 2).alias("price"))


def hash_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stored hash is no longer theirs."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = rows.withColumn("stored", ledger.content_hash("o_orderkey", "o_custkey", "o_orderstatus"))
    touched = stored.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 113 == 0, "X").otherwise(F.col("o_orderstatus")))
    return ledger.verified(touched, "stored", "o_orderkey", "o_custkey", "o_orderstatus").filter("NOT verified").select("o_orderkey")


PUBLISHED_SQL = BLEND_SQL + """,
offers AS (
  SELECT f.match_id, f.competition, f.kickoff, f.src_status, f.hg, f.ag, round(1.5e0 + (f.match_id % 17) / 10e0, 2) AS odds, v AS version_seq,
    f.kickoff + to_minutes(CASE v WHEN 1 THEN -180 WHEN 2 THEN CASE WHEN f.match_id % 5 = 0 THEN -12 ELSE -60 END ELSE CASE WHEN f.match_id % 17 = 0 THEN 5 ELSE -10 END END) AS frozen_at,
    CASE WHEN v = 2 THEN b.p1 ELSE f.p1 END AS p1, CASE WHEN v = 2 THEN b.px ELSE f.px END AS px, CASE WHEN v = 2 THEN b.p2 ELSE f.p2 END AS p2, over15, over25, over35, btts
  FROM forecast f JOIN blend b ON b.match_id = f.match_id, (VALUES (1), (2), (3)) t(v)),
reference AS (
  SELECT match_id, CAST(coalesce(max(version_seq) FILTER (WHERE frozen_at <= kickoff - INTERVAL 15 MINUTE), max(version_seq) FILTER (WHERE frozen_at <= kickoff)) AS INTEGER) AS version_seq,
    count(*) FILTER (WHERE frozen_at <= kickoff - INTERVAL 15 MINUTE) > 0 AS at_t15 FROM offers GROUP BY match_id),
legs AS (""" + " UNION ALL ".join(f"SELECT match_id, version_seq, '{f}' AS family, {i} AS leg, '{s}' AS selection, {p} AS p FROM offers" for f, legs in rating.FAMILIES.items() for i, (s, p) in enumerate(legs)) + """),
picks AS (SELECT * FROM legs QUALIFY row_number() OVER (PARTITION BY match_id, version_seq, family ORDER BY p DESC, leg) = 1),
judged AS (
  SELECT o.*, k.family, k.selection, k.p,
    CASE family WHEN '1N2' THEN CASE WHEN hg > ag THEN '1' WHEN hg = ag THEN 'N' ELSE '2' END WHEN 'DC' THEN CASE WHEN hg > ag THEN '1N' WHEN hg < ag THEN 'N2' ELSE 'NUL' END
      WHEN 'BTTS' THEN CASE WHEN hg > 0 AND ag > 0 THEN 'OUI' ELSE 'NON' END ELSE CASE WHEN hg + ag >= CAST(substr(family, 2, 1) AS INTEGER) + 1 THEN 'PLUS' ELSE 'MOINS' END END AS outcome
  FROM offers o JOIN picks k ON k.match_id = o.match_id AND k.version_seq = o.version_seq),
scored AS (
  SELECT *, CASE WHEN family = 'DC' THEN CASE selection WHEN '1N' THEN hg >= ag WHEN 'N2' THEN hg <= ag ELSE hg <> ag END ELSE selection = outcome END AS won FROM judged),
everything AS (
  SELECT *, CASE WHEN family = '1N2' THEN pow(p1 - CASE WHEN outcome = '1' THEN 1 ELSE 0 END, 2) + pow(px - CASE WHEN outcome = 'N' THEN 1 ELSE 0 END, 2) + pow(p2 - CASE WHEN outcome = '2' THEN 1 ELSE 0 END, 2)
      ELSE 2 * pow(p - CASE WHEN won THEN 1 ELSE 0 END, 2) END AS brier,
    -ln(least(greatest(CASE WHEN family = '1N2' THEN CASE outcome WHEN '1' THEN p1 WHEN 'N' THEN px ELSE p2 END WHEN won THEN p ELSE 1 - p END, 1e-12), 1)) AS logloss
  FROM scored WHERE src_status <> 'P'),
settled AS (SELECT e.* FROM everything e JOIN reference r ON r.match_id = e.match_id AND r.version_seq = e.version_seq)"""
PUBLISHED_SQL = "WITH " + PUBLISHED_SQL.replace("@day", FORECAST_DAY)
_BOARD = "count(*) AS n, round(100 * avg(CASE WHEN won THEN 1e0 ELSE 0e0 END), 1) AS accuracy, round(avg(brier), 4) AS brier"
_PROFIT = ", priced AS (SELECT *, CASE WHEN won THEN odds - 1 ELSE -1e0 END AS pnl FROM settled WHERE family = '1N2')"

QUERIES = {f.__name__: f for f in (
    settle_markets, market_scoreboard, competition_scoreboard_top12, model_scoreboard, headline_block, safest_pick_accuracy, roi_yield, max_drawdown, calibration_bins, quality_calibration,
    evaluation_reference_version, verdicts, history_page, match_history_tree, version_by_hash, late_refused, upsert_merge_matches, insert_once_antijoin, immutability_violations, fk_violations, price_history_latest3, hash_verification,
)}
ORACLES = {
    "settle_markets": PUBLISHED_SQL + " SELECT match_id, version_seq, family, selection, outcome, won, round(p, 6) AS p, round(brier, 6) AS brier, round(logloss, 6) AS logloss FROM everything",
    "market_scoreboard": PUBLISHED_SQL + f" SELECT family, {_BOARD}, round(avg(logloss), 4) AS logloss FROM settled GROUP BY family",
    "competition_scoreboard_top12": PUBLISHED_SQL + f" SELECT competition, {_BOARD}, round(avg(logloss), 4) AS logloss FROM settled GROUP BY competition ORDER BY n DESC, competition LIMIT 12",
    "model_scoreboard": PUBLISHED_SQL + f" SELECT version_seq, {_BOARD} FROM everything GROUP BY version_seq",
    "headline_block": PUBLISHED_SQL + " SELECT count(DISTINCT match_id) AS matches, count(DISTINCT (match_id, version_seq)) AS versions, CASE WHEN count(DISTINCT match_id) >= 20 THEN 'ok' ELSE 'rebuilding' END AS status, CASE WHEN count(DISTINCT match_id) >= 20 THEN round(100 * avg(CASE WHEN won THEN 1e0 ELSE 0e0 END), 1) END AS accuracy, CASE WHEN count(DISTINCT match_id) >= 20 THEN round(avg(brier), 4) END AS brier, CASE WHEN count(DISTINCT match_id) >= 20 THEN round(avg(logloss), 4) END AS logloss FROM settled WHERE family = '1N2'",
    "safest_pick_accuracy": PUBLISHED_SQL + ", best AS (SELECT * FROM settled QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY p DESC, family DESC) = 1) SELECT count(*) AS n, round(100 * avg(CASE WHEN won THEN 1e0 ELSE 0e0 END), 1) AS accuracy FROM best",
    "roi_yield": PUBLISHED_SQL + _PROFIT + " SELECT count(*) AS n, round(sum(pnl), 4) AS pnl, CASE WHEN count(*) >= 5 THEN round(100 * sum(pnl) / count(*), 2) END AS yield_pct FROM priced",
    "max_drawdown": PUBLISHED_SQL + _PROFIT + ", run AS (SELECT *, sum(pnl) OVER w AS equity FROM priced WINDOW w AS (PARTITION BY competition ORDER BY frozen_at, match_id ROWS UNBOUNDED PRECEDING)), top AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY competition ORDER BY frozen_at, match_id ROWS UNBOUNDED PRECEDING)) AS peak FROM run) SELECT competition, round(max(peak - equity), 4) AS max_drawdown FROM top GROUP BY competition",
    "calibration_bins": PUBLISHED_SQL + " SELECT CAST(floor(least(greatest(p, 0), 0.9999e0) * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(CASE WHEN won THEN 1e0 ELSE 0e0 END), 4) AS rate FROM settled GROUP BY 1",
    "quality_calibration": "WITH r AS (SELECT ((l.doc_id * 7 + n_chars) % 100) / 100e0 AS p, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT CAST(floor(least(greatest(p, 0), 0.9999e0) * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END), 4) AS rate FROM r GROUP BY 1",
    "evaluation_reference_version": PUBLISHED_SQL + " SELECT * FROM reference WHERE version_seq IS NOT NULL",
    "verdicts": PUBLISHED_SQL + " SELECT match_id, max(outcome) FILTER (WHERE family = '1N2') AS real, bool_or(won) FILTER (WHERE family = '1N2') AS pick_ok, arg_max(won, row(p, family)) AS safest_ok FROM settled GROUP BY match_id",
    "history_page": PUBLISHED_SQL + ", last AS (SELECT o.match_id, o.version_seq, o.frozen_at, o.src_status, s.family, s.selection FROM offers o JOIN picks s ON s.match_id = o.match_id AND s.version_seq = o.version_seq ORDER BY frozen_at DESC, o.match_id, o.version_seq, family LIMIT 600), st AS (SELECT *, CASE src_status WHEN 'F' THEN 'SETTLED' WHEN 'P' THEN 'VOID' ELSE 'PREDICTION_FROZEN' END AS status FROM last) SELECT match_id, version_seq, family, selection, status FROM st WHERE family IN ('1N2', 'BTTS') AND status <> 'VOID' ORDER BY frozen_at DESC, match_id, version_seq, family LIMIT 50 OFFSET 20",
    "match_history_tree": PUBLISHED_SQL + ", v AS (SELECT match_id, version_seq, string_agg(family || '=' || selection, ',' ORDER BY family) AS picks FROM picks GROUP BY ALL) SELECT match_id, count(*) AS versions, string_agg(version_seq || ':' || picks, ';' ORDER BY version_seq) AS tree FROM v GROUP BY match_id",
    "version_by_hash": "WITH e AS (SELECT *, sha256(event_type || '|' || coalesce(CAST(floor(value / 50) AS BIGINT), -1)) AS hash FROM events), f AS (SELECT user_id, hash, ts, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, hash ORDER BY ts, event_id) = 1), n AS (SELECT user_id, hash, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, hash) AS INTEGER) AS version_seq FROM f) SELECT *, version_seq - 1 AS replaces FROM n",
    "late_refused": PUBLISHED_SQL + " SELECT competition, count(*) AS offered, count(*) FILTER (WHERE frozen_at < kickoff) AS kept, max(version_seq) FILTER (WHERE frozen_at < kickoff) AS last_version FROM offers GROUP BY competition",
    "upsert_merge_matches": "WITH " + FIXTURES_SQL + ", s AS (SELECT match_id, CASE WHEN hg > 0 THEN hg END AS hg, 'v' || home_id AS venue FROM fixtures WHERE match_id % 3 <> 0), i AS (SELECT match_id, CASE WHEN ag > 1 THEN ag + 10 END AS hg, CASE WHEN match_id % 4 <> 0 THEN 'new' END AS venue FROM fixtures WHERE match_id % 2 = 0) SELECT coalesce(s.match_id, i.match_id) AS match_id, CAST(coalesce(i.hg, s.hg) AS DOUBLE) AS hg, coalesce(i.venue, s.venue) AS venue FROM s FULL JOIN i ON i.match_id = s.match_id",
    "insert_once_antijoin": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_suppkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1",
    "immutability_violations": "SELECT c_custkey, CASE WHEN c_custkey % 101 = 0 THEN 'deleted' WHEN c_custkey % 194 = 0 THEN 'c_nationkey,c_mktsegment' ELSE 'c_nationkey' END AS violation FROM customer WHERE c_custkey % 101 = 0 OR c_custkey % 97 = 0",
    "fk_violations": "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "price_history_latest3": "SELECT l_partkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS INTEGER) AS rank, l_orderkey, round(l_extendedprice, 2) AS price FROM lineitem QUALIFY rank <= 3",
    "hash_verification": "SELECT o_orderkey FROM orders WHERE o_orderkey % 113 = 0",
}
