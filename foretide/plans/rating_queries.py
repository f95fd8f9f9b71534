"""Queries of ratings and forecasts, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.operators import rating
from foretide.plans.views import AFTER_ALL, FIXTURES_SQL, FORECAST_DAY, fixtures

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
_SUMS = ["sw", "gf", "ga", "home_sw", "home_gf", "home_ga", "away_sw", "away_gf", "away_ga"]
_COUNTS = ["n", "home_n", "away_n"]


def team_weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.team_rates(fixtures(spark, sf_dir), AFTER_ALL).select("competition", "team_id", *_COUNTS, *r6(*_SUMS))


def team_table_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.team_rates(fixtures(spark, sf_dir), AFTER_ALL).select("competition", "team_id", "n", "w", "d", "l", "pts")


def team_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.team_slices(rating.team_rates(fixtures(spark, sf_dir), AFTER_ALL))


def league_averages_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.league_averages(fixtures(spark, sf_dir), AFTER_ALL).select("competition", "n", *r6("home_avg", "away_avg"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.forecasts(fixtures(spark, sf_dir), FORECAST_DAY)


def with_odds(df: DataFrame) -> DataFrame:
    """Implied probabilities with a margin, made from the key."""
    k = F.col("match_id")
    return df.withColumns({"odds_home": 0.30 + (k % 31) / 100.0, "odds_draw": 0.20 + (k % 13) / 100.0, "odds_away": 0.25 + (k % 23) / 100.0})


def fixture_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.col(c) for c in ("p1", "px", "p2")]
    return forecast(spark, sf_dir).select("match_id", "home_id", "away_id", *r6("lam_home", "lam_away", "reliab", "p1", "px", "p2", "over15", "over25", "over35", "btts"), rating.pick(*p).alias("pick"))


def scoreline_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most probable scores of each fixture (K02): a slice of a sorted array, no window."""
    order = F.array_sort(F.transform("cells", lambda c: F.struct((-c["p"]).alias("p"), (-c["h"]).alias("h"), (-c["a"]).alias("a"))))
    best = forecast(spark, sf_dir).select("match_id", F.posexplode(F.slice(order, 1, 5)).alias("rank", "c"))
    score = F.concat_ws("-", (-F.col("c.h")).cast("string"), (-F.col("c.a")).cast("string"))
    return best.select("match_id", (F.col("rank") + 1).alias("rank"), score.alias("score"), F.round(-F.col("c.p"), 6).alias("p"))


def market_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.market_board(forecast(spark, sf_dir)).select("match_id", "position", "market", "kind", *r6("p"))


def safest_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.safest_pick(forecast(spark, sf_dir)).select("match_id", "market", "kind", *r6("p"), "stars")


def confidence_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.confidence(forecast(spark, sf_dir)).select("match_id", *r6("confidence"), "stars")


def odds_blend_devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.blended(with_odds(forecast(spark, sf_dir))).select("match_id", *r6("market_1", "market_x", "market_2", "market_weight", "p1", "px", "p2"))


def value_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.value_bets(rating.blended(with_odds(forecast(spark, sf_dir)))).select("match_id", "value_side", *r6("value_edge"))


def absence_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures(spark, sf_dir)
    targets = rows.filter(F.col("kickoff") >= F.lit(FORECAST_DAY).cast("timestamp_ntz")).withColumns({"home_absences": F.col("match_id") % 7, "away_absences": F.col("match_id") % 3})
    return rating.expected_goals(targets, rating.team_rates(rows, FORECAST_DAY), rating.league_averages(rows, FORECAST_DAY)).select("match_id", *r6("lam_home", "lam_away"))


def live_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("match_id")
    rows = forecast(spark, sf_dir).withColumns({"minute": (k % 97).cast("int"), "home_momentum": (k % 20) / 20.0, "away_momentum": 1 - (k % 20) / 20.0})
    return rating.live_goals(rows).select("match_id", "minute", *r6("lam_home", "lam_away"))


def market_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.market_families(forecast(spark, sf_dir)).select("match_id", "family", "selection", *r6("p"))


RATES_SQL = f"""{FIXTURES_SQL},
sides AS (
  SELECT match_id, competition, kickoff, 'home' AS loc, home_id AS team_id, away_id AS opponent_id, hg AS gf, ag AS ga FROM fixtures
  UNION ALL SELECT match_id, competition, kickoff, 'away', away_id, home_id, ag, hg FROM fixtures),
weighted AS (
  SELECT *, pow(0.5e0, date_diff('day', CAST(kickoff AS DATE), DATE '@day') / 70e0) AS w FROM sides
  WHERE kickoff >= DATE '@day' - 150 AND kickoff < TIMESTAMP '@day'),
rates AS (
  SELECT competition, team_id, count(*) AS n, sum(w) AS sw, sum(w * gf) AS gf, sum(w * ga) AS ga,
    count(*) FILTER (WHERE loc = 'home') AS home_n, coalesce(sum(w) FILTER (WHERE loc = 'home'), 0) AS home_sw,
    coalesce(sum(w * gf) FILTER (WHERE loc = 'home'), 0) AS home_gf, coalesce(sum(w * ga) FILTER (WHERE loc = 'home'), 0) AS home_ga,
    count(*) FILTER (WHERE loc = 'away') AS away_n, coalesce(sum(w) FILTER (WHERE loc = 'away'), 0) AS away_sw,
    coalesce(sum(w * gf) FILTER (WHERE loc = 'away'), 0) AS away_gf, coalesce(sum(w * ga) FILTER (WHERE loc = 'away'), 0) AS away_ga,
    count(*) FILTER (WHERE gf > ga) AS w_, count(*) FILTER (WHERE gf = ga) AS d, count(*) FILTER (WHERE gf < ga) AS l
  FROM weighted GROUP BY competition, team_id),
leagues AS (
  SELECT competition, count(*) AS n,
    least(greatest(CASE WHEN sum(w) > 1 THEN sum(w * gf) / sum(w) ELSE 1.45e0 END, 0.9e0), 2.3e0) AS home_avg,
    least(greatest(CASE WHEN sum(w) > 1 THEN sum(w * ga) / sum(w) ELSE 1.10e0 END, 0.7e0), 2.0e0) AS away_avg
  FROM weighted WHERE loc = 'home' GROUP BY competition)"""


def _rate_sql(p: str, loc: str, goals: str) -> str:
    over = f"{p}.{goals} / {p}.sw"
    return f"CASE WHEN {p}.sw > 0.05e0 THEN CASE WHEN {p}.{loc}_n >= 3 AND {p}.{loc}_sw > 0.3e0 THEN 0.65e0 * {p}.{loc}_{goals} / {p}.{loc}_sw + 0.35e0 * {over} ELSE {over} END END"


def _shrunk_sql(p: str, loc: str, goals: str) -> str:
    return f"((coalesce({_rate_sql(p, loc, goals)}, g.{loc}_avg) * {p}.sw + g.{loc}_avg * 3e0) / ({p}.sw + 3e0))"


GOALS_SQL = f"""{RATES_SQL},
goals AS (
  SELECT f.*, least(1e0, (h.sw + a.sw) / 14e0) AS reliab,
    least(greatest({_shrunk_sql("h", "home", "gf")} * {_shrunk_sql("a", "away", "ga")} / greatest(g.away_avg, 0.5e0) * g.home_avg / greatest(g.home_avg, 0.5e0), 0.15e0), 4.5e0) AS lam_home,
    least(greatest({_shrunk_sql("a", "away", "gf")} * {_shrunk_sql("h", "home", "ga")} / greatest(g.home_avg, 0.5e0) * g.away_avg / greatest(g.away_avg, 0.5e0), 0.10e0), 4e0) AS lam_away
  FROM fixtures f JOIN rates h ON h.competition = f.competition AND h.team_id = f.home_id
  JOIN rates a ON a.competition = f.competition AND a.team_id = f.away_id JOIN leagues g ON g.competition = f.competition
  WHERE f.kickoff >= TIMESTAMP '@day')"""
FORECAST_SQL = f"""{GOALS_SQL},
grid AS (
  SELECT match_id, i AS h, j AS a, exp(-lam_home) * pow(lam_home, i) / factorial(CAST(i AS INTEGER)) * (exp(-lam_away) * pow(lam_away, j) / factorial(CAST(j AS INTEGER))) AS p
  FROM goals, generate_series(0, 10) x(i), generate_series(0, 10) y(j)),
chances AS (
  SELECT match_id, sum(p) FILTER (WHERE h > a) AS p1, sum(p) FILTER (WHERE h = a) AS px, sum(p) FILTER (WHERE h < a) AS p2, sum(p) FILTER (WHERE h + a > 1) AS over15,
    sum(p) FILTER (WHERE h + a > 2) AS over25, sum(p) FILTER (WHERE h + a > 3) AS over35, sum(p) FILTER (WHERE h > 0 AND a > 0) AS btts FROM grid GROUP BY match_id),
forecast AS (SELECT goals.*, c.* EXCLUDE (match_id) FROM goals JOIN chances c ON c.match_id = goals.match_id)"""
BLEND_SQL = f"""{FORECAST_SQL},
quoted AS (SELECT *, 0.30e0 + (match_id % 31) / 100e0 AS oh, 0.20e0 + (match_id % 13) / 100e0 AS od, 0.25e0 + (match_id % 23) / 100e0 AS oa, least(0.65e0, 0.25e0 + 0.45e0 * (1 - reliab)) AS mw FROM forecast),
blend AS (
  SELECT match_id, oh / (oh + od + oa) AS market_1, od / (oh + od + oa) AS market_x, oa / (oh + od + oa) AS market_2, mw AS market_weight,
    (1 - mw) * p1 + mw * oh / (oh + od + oa) AS p1, (1 - mw) * px + mw * od / (oh + od + oa) AS px, (1 - mw) * p2 + mw * oa / (oh + od + oa) AS p2 FROM quoted)"""
BOARD_SQL = ",\nboard AS (" + " UNION ALL ".join(f"SELECT match_id, {i} AS position, '{name}' AS market, '{kind}' AS kind, {p} AS p FROM forecast" for i, (name, p, kind) in enumerate(rating.MARKETS)) + ")"
FAMILY_SQL = ",\nlegs AS (" + " UNION ALL ".join(f"SELECT match_id, '{f}' AS family, {i} AS leg, '{s}' AS selection, {p} AS p FROM forecast" for f, legs in rating.FAMILIES.items() for i, (s, p) in enumerate(legs)) + """),
families AS (SELECT * FROM legs QUALIFY row_number() OVER (PARTITION BY match_id, family ORDER BY p DESC, leg) = 1)"""


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def at(sql: str, day: str) -> str:
    return "WITH " + sql.replace("@day", day)


QUERIES = {f.__name__: f for f in (team_weighted_rates, team_table_points, team_slices, league_averages_clamped, fixture_forecast, scoreline_top5, market_board, safest_pick, confidence_stars, odds_blend_devig, value_bets, absence_adjustment, live_rescale, market_families)}
ORACLES = {
    "team_weighted_rates": at(RATES_SQL, AFTER_ALL) + f" SELECT competition, team_id, {', '.join(_COUNTS)}, {_rounded(*_SUMS)} FROM rates",
    "team_table_points": at(RATES_SQL, AFTER_ALL) + " SELECT competition, team_id, n, w_ AS w, d, l, 3 * w_ + d AS pts FROM rates",
    "team_slices": at(RATES_SQL, AFTER_ALL) + " SELECT competition, team_id, n, w_ AS w, d, l, round(gf / greatest(sw, 0.01e0), 2) AS gf, round(ga / greatest(sw, 0.01e0), 2) AS ga FROM rates",
    "league_averages_clamped": at(RATES_SQL, AFTER_ALL) + f" SELECT competition, n, {_rounded('home_avg', 'away_avg')} FROM leagues",
    "fixture_forecast": at(FORECAST_SQL, FORECAST_DAY) + f" SELECT match_id, home_id, away_id, {_rounded('lam_home', 'lam_away', 'reliab', 'p1', 'px', 'p2', 'over15', 'over25', 'over35', 'btts')}, CASE WHEN p1 >= px AND p1 >= p2 THEN '1' WHEN px >= p2 THEN 'N' ELSE '2' END AS pick FROM forecast",
    "scoreline_top5": at(FORECAST_SQL, FORECAST_DAY) + " SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h DESC, a DESC) AS INTEGER) AS rank, h || '-' || a AS score, round(p, 6) AS p FROM grid QUALIFY rank <= 5",
    "market_board": at(FORECAST_SQL + BOARD_SQL, FORECAST_DAY) + f" SELECT match_id, position, market, kind, {_rounded('p')} FROM board",
    "safest_pick": at(FORECAST_SQL + BOARD_SQL, FORECAST_DAY) + " SELECT match_id, market, kind, round(p, 6) AS p, CASE WHEN p < 0.55 THEN 1 WHEN p < 0.65 THEN 2 WHEN p < 0.72 THEN 3 WHEN p < 0.82 THEN 4 ELSE 5 END AS stars FROM board QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY p DESC, position) = 1",
    "confidence_stars": at(FORECAST_SQL, FORECAST_DAY) + ", c AS (SELECT match_id, (greatest(p1, px, p2) - 1e0 / 3) / (2e0 / 3) * (0.35e0 + 0.65e0 * reliab) AS confidence FROM forecast) SELECT match_id, round(confidence, 6) AS confidence, CAST(least(greatest(round(1 + 4 * confidence), 1), 5) AS INTEGER) AS stars FROM c",
    "odds_blend_devig": at(BLEND_SQL, FORECAST_DAY) + f" SELECT match_id, {_rounded('market_1', 'market_x', 'market_2', 'market_weight', 'p1', 'px', 'p2')} FROM blend",
    "value_bets": at(BLEND_SQL, FORECAST_DAY) + ", legs AS (SELECT match_id, 0 AS leg, '1' AS value_side, p1 AS p, p1 - market_1 AS edge FROM blend UNION ALL SELECT match_id, 1, 'N', px, px - market_x FROM blend UNION ALL SELECT match_id, 2, '2', p2, p2 - market_2 FROM blend) SELECT match_id, value_side, round(edge, 6) AS value_edge FROM legs WHERE edge >= 0.08 AND p >= 0.35 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY edge DESC, leg) = 1",
    "absence_adjustment": at(GOALS_SQL, FORECAST_DAY) + " SELECT match_id, round(lam_home * (1 - 0.025e0 * least(4, match_id % 7)), 6) AS lam_home, round(lam_away * (1 - 0.025e0 * least(4, match_id % 3)), 6) AS lam_away FROM goals",
    "live_rescale": at(GOALS_SQL, FORECAST_DAY) + ", m AS (SELECT *, CAST(match_id % 97 AS INTEGER) AS minute, (90 - least(greatest(match_id % 97, 1), 90)) / 90e0 AS rest, (match_id % 20) / 20e0 AS mh FROM goals) SELECT match_id, minute, round(CASE WHEN rest <= 0.01 THEN 1e-6 ELSE lam_home * rest END * least(greatest(0.35e0 + 1.3e0 * mh, 0.5e0), 1.75e0), 6) AS lam_home, round(CASE WHEN rest <= 0.01 THEN 1e-6 ELSE lam_away * rest END * least(greatest(0.35e0 + 1.3e0 * (1 - mh), 0.5e0), 1.75e0), 6) AS lam_away FROM m",
    "market_families": at(FORECAST_SQL + FAMILY_SQL, FORECAST_DAY) + " SELECT match_id, family, selection, round(p, 6) AS p FROM families",
}
