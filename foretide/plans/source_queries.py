"""Queries of the sources: bodies as feeds give them, made from the given tables, are parsed again; with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.plans.views import FIXTURES_SQL, fixtures, table
from foretide.sources import parsers
from foretide.streaming import pipelines


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _side(side: str, goals: str) -> Column:
    key = F.col(f"{side}_id").cast("string")
    name = F.when(F.col("match_id") % 41 == 0, "TBD").otherwise(F.concat(F.lit("Team "), key)) if side == "away" else F.concat(F.lit("Team "), key)
    return _struct(homeAway=F.lit(side), score=F.col(goals).cast("string"), team=_struct(id=F.when(F.col("match_id") % 43 != 0, key), displayName=name), linescores=F.array(_struct(value=(F.col(goals) / 2).cast("int").cast("double"))))


def _event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fixture as an event, some of them read twice: without a score first."""
    rows = fixtures(spark, sf_dir).withColumn("read_at", F.explode(F.when(F.col("match_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    rows = rows.withColumns({c: F.when(F.col("read_at") == 2, F.col(c)) for c in ("hg", "ag")})
    state = _struct(state=F.when(F.col("src_status") == "O", "pre").otherwise("post"), completed=F.col("src_status") == "F", detail=F.lit("FT"))
    game = _struct(venue=_struct(fullName=F.concat(F.lit("Park "), F.col("home_id").cast("string"))), competitors=F.array(_side("home", "hg"), _side("away", "ag")))
    event = _struct(id=F.col("match_id").cast("string"), date=F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm'Z'"), status=_struct(type=state), competitions=F.array(game))
    return rows.select("read_at", F.to_json(event).alias("body"))


def events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of days: each event as it was read last, undecided and nameless sides dropped."""
    rows = parsers.window_of_events(parsers.events(_event_bodies(spark, sf_dir)), "2000-01-01", "2001-06-30")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.unix_seconds("kickoff").alias("kickoff"), "state", "completed", "home_name", "away_name", "home_score", "away_score", "home_half", "venue")


def statistics_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team figures in long form; shares lose their sign, what is no number goes."""
    k = F.col("s_suppkey")
    figure = lambda name, value: _struct(name=F.lit(name), displayValue=value)
    figures = F.array(figure("possessionPct", F.concat((k % 60 + 20).cast("string"), F.lit("%"))), figure("totalShots", (k % 17).cast("string")), figure("note", F.lit("n/a")))
    team = _struct(team=_struct(id=k.cast("string")), statistics=figures)
    bodies = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("match_id"), F.to_json(_struct(boxscore=_struct(teams=F.array(team)))).alias("body"))
    return parsers.statistics(bodies)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    word = F.element_at(F.array(*map(F.lit, ("Goal by", "Red card for", "Yellow card for", "Substitution of", "Penalty by", "Corner by"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    entry = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), _struct(displayValue=F.concat(F.col("l_linenumber").cast("string"), F.lit("'"))).alias("clock"), F.concat(word, F.lit(" "), F.col("l_partkey").cast("string")).alias("text"))
    rows = lines.groupBy((F.col("l_orderkey") % 500).alias("match_id")).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("l_orderkey").alias("o"), entry.alias("e")))), 1, 60).alias("es"))
    keys = F.transform("es", lambda x: F.struct(x["e"]["clock"].alias("clock"), x["e"]["text"].alias("text")))
    odds = lambda c: _struct(moneyLine=c.cast("string"))
    k = F.col("match_id")
    picks = F.array(_struct(provider=_struct(name=F.lit("book")), homeTeamOdds=odds(k % 300 - 150), awayTeamOdds=odds(k % 200 + 100), drawOdds=odds(k * 0)))
    return rows.select("match_id", F.to_json(_struct(keyEvents=keys, pickcenter=F.when(k % 5 != 0, picks))).alias("body"))


def timeline_last25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 25 entries of each game, by their icons."""
    out = parsers.timeline(_summaries(spark, sf_dir))
    return out.groupBy("match_id", "icon").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))


def moneylines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.moneylines(_summaries(spark, sf_dir))
    number = lambda c: F.coalesce(F.round(c, 4), F.lit(-1.0)).alias(c)
    return out.select("match_id", "provider", *map(number, ("p_home", "p_draw", "p_away", "odds_home", "odds_draw", "odds_away")))


def standings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of groups: rank, or 999 without one, and points."""
    k = F.col("s_suppkey")
    stat = lambda name, value: _struct(name=F.lit(name), displayValue=value.cast("string"))
    stats = F.when(k % 6 == 0, F.array(stat("points", k % 90))).otherwise(F.array(stat("rank", k % 20 + 1), stat("points", k % 90)))
    entry = _struct(team=_struct(id=k.cast("string"), displayName=F.col("s_name")), stats=stats)
    group = _struct(name=F.concat(F.lit("Group "), F.col("s_nationkey").cast("string")), standings=_struct(entries=F.array(entry)))
    bodies = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("league"), F.to_json(_struct(children=F.array(group))).alias("body"))
    return parsers.standings(bodies)


def _season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's file as its reader gives it: all columns are text, days in two forms."""
    k = F.col("match_id")
    day = F.when(k % 2 == 0, F.date_format("kickoff", "dd/MM/yyyy")).otherwise(F.date_format("kickoff", "dd/MM/yy"))
    quote = lambda n: F.when(k % n != 0, (1.5 + (k % (10 * n)) / 10).cast("string")).otherwise("")
    rows = fixtures(spark, sf_dir)
    return rows.select(
        F.col("competition").alias("Div"), day.alias("Date"), F.concat(F.lit("Team "), F.col("home_id").cast("string")).alias("HomeTeam"), F.when(k % 47 != 0, F.concat(F.lit("Team "), F.col("away_id").cast("string"))).alias("AwayTeam"),
        F.col("hg").cast("double").cast("string").alias("FTHG"), F.col("ag").cast("string").alias("FTAG"), F.when(F.col("hg") > F.col("ag"), "H").otherwise("A").alias("FTR"),
        quote(3).alias("B365H"), quote(4).alias("B365D"), quote(5).alias("B365A"), quote(7).alias("PSCH"), F.lit("1.9").alias("B365>2.5"), F.lit("2.0").alias("AHH"),
    )


def season_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, D07."""
    return parsers.season_matches(_season(spark, sf_dir)).groupBy("competition", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("hg").alias("hg"), F.sum("ag").alias("ag"))


def season_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way quotes by bookmaker and time; totals and handicaps are none."""
    rows = parsers.season_odds(_season(spark, sf_dir))
    return rows.groupBy("bookmaker", "timing", "leg").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("odds"), 2).alias("odds"))


def german_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished matches with their final result, whatever stands before it."""
    k = F.col("match_id")
    score = lambda kind, name, h, a: _struct(resultTypeID=F.lit(kind), resultName=F.lit(name), pointsTeam1=h.cast("int"), pointsTeam2=a.cast("int"))
    results = F.array(score(1, "Halbzeit", F.lit(0), F.lit(0)), score(2, "Endergebnis", F.col("hg"), F.col("ag")))
    match = _struct(matchID=k, matchDateTimeUTC=F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss'Z'"), team1=_struct(teamName=F.concat(F.lit("T"), F.col("home_id").cast("string"))), team2=_struct(teamName=F.concat(F.lit("T"), F.col("away_id").cast("string"))), matchIsFinished=F.col("src_status") == "F", matchResults=results)
    bodies = fixtures(spark, sf_dir).select(F.to_json(F.array(match)).alias("body"))
    return parsers.german_matches(bodies).withColumn("kickoff", F.unix_seconds("kickoff"))


def game_events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games by the team in possession, corners as passes of their kind."""
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "Pass").when(e % 4 == 1, "Shot").otherwise("Carry")
    event = _struct(type=_struct(name=kind), team=_struct(name=F.concat(F.lit("a"), (e % 2).cast("string"))), possession_team=F.when(e % 5 != 0, _struct(name=F.concat(F.lit("p"), (e % 2).cast("string")))), shot=F.when(e % 4 == 1, _struct(statsbomb_xg=F.round(F.col("value") / 1000, 3), outcome=_struct(name=F.lit("Goal")))), **{"pass": F.when(e % 4 == 0, _struct(type=_struct(name=F.when(e % 8 == 0, "Corner").otherwise("Throw-in"))))})
    bodies = table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"), F.to_json(F.array(event)).alias("body"))
    rows = parsers.game_events(bodies)
    return rows.groupBy("team", "type").agg(F.count(F.lit(1)).alias("n"), F.count("outcome").alias("goals"), F.coalesce(F.round(F.sum("xg"), 3), F.lit(0.0)).alias("xg"))


def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a search with their aliases."""
    k = F.col("n_nationkey")
    one = lambda i: _struct(id=F.concat(F.lit(f"Q{i}"), k.cast("string")), label=F.col("n_name"), description=F.lit("d"), aliases=F.when(k % 2 == i, F.array(F.lower("n_name"), F.lit("x"))))
    bodies = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(_struct(search=F.array(one(0), one(1)))).alias("body"))
    return parsers.entities(bodies)


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of several sources by name, those that one lacks null."""
    at = F.lit("2001-08-02")
    one = parsers.datapoints(table(spark, sf_dir, "orders"), ["o_orderkey"], {"status": "o_orderstatus", "price": "o_totalprice"}, "feed", at).withColumnRenamed("o_orderkey", "match_id")
    two = parsers.datapoints(table(spark, sf_dir, "customer"), ["c_custkey"], {"segment": "c_mktsegment"}, "registry", at).withColumnRenamed("c_custkey", "team_id")
    rows = parsers.all_points(one, two)
    return rows.groupBy("source", "data_type").agg(F.count("match_id").alias("matches"), F.count("team_id").alias("teams"), F.countDistinct("value").alias("values"))


def stream_reference_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user that was in force a quarter of an hour before its own start, told once by a timer (T-05, T-06)."""
    from foretide.plans.feed_queries import _drained, _stream

    start = F.expr("TIMESTAMP_NTZ '2024-01-05 12:00:00' + make_dt_interval(CAST(user_id % 25 AS INT))")
    rows = _stream(spark, sf_dir).withColumn("kickoff", start)
    offers = pipelines.on_time(rows).select(F.col("user_id").alias("match_id"), "ts", "kickoff", F.col("event_id").alias("version"))
    return _drained(spark, pipelines.reference_marks(offers), "append").select("match_id", "version")


QUERIES = {f.__name__: f for f in (
    events_scan, statistics_scan, timeline_last25, moneylines_scan, standings_scan, season_matches, season_odds, german_scan, game_events_scan, entity_scan, all_sources, stream_reference_marks,
)}
_SEASON = "WITH " + FIXTURES_SQL + ", s AS (SELECT * FROM fixtures WHERE match_id % 47 <> 0)"
_QUOTES = [("bet365", "opening", "H", 3), ("bet365", "opening", "D", 4), ("bet365", "opening", "A", 5), ("pinnacle", "closing", "H", 7)]
_ENTRIES = "WITH l AS (SELECT l_orderkey % 500 AS match_id, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem QUALIFY rn <= 60), c AS (SELECT match_id, max(rn) AS m FROM l GROUP BY 1)"
ORACLES = {
    "events_scan": "WITH " + FIXTURES_SQL + """ SELECT match_id AS event_id, CAST(epoch(date_trunc('minute', kickoff)) AS BIGINT) AS kickoff, CASE src_status WHEN 'O' THEN 'pre' ELSE 'post' END AS state, src_status = 'F' AS completed, 'Team ' || home_id AS home_name, 'Team ' || away_id AS away_name,
      CAST(hg AS INTEGER) AS home_score, CAST(ag AS INTEGER) AS away_score, CAST(hg // 2 AS INTEGER) AS home_half, 'Park ' || home_id AS venue FROM fixtures WHERE CAST(kickoff AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2001-06-30' AND match_id % 41 <> 0 AND match_id % 43 <> 0""",
    "statistics_scan": "SELECT s_nationkey AS match_id, s_suppkey::VARCHAR AS team_id, 'possessionPct' AS name, CAST(s_suppkey % 60 + 20 AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_nationkey, s_suppkey::VARCHAR, 'totalShots', CAST(s_suppkey % 17 AS DOUBLE) FROM supplier",
    "timeline_last25": _ENTRIES + ", t AS (SELECT l.match_id, rn - greatest(m - 25, 0) - 1 AS position, ['goal', 'red', 'yellow', 'sub', 'penalty', 'other'][l_partkey % 6 + 1] AS icon FROM l JOIN c ON c.match_id = l.match_id WHERE rn > m - 25) SELECT match_id, icon, count(*) AS n, CAST(min(position) AS INTEGER) AS first FROM t GROUP BY 1, 2",
    "moneylines_scan": """WITH m AS (SELECT DISTINCT l_orderkey % 500 AS match_id FROM lineitem), o AS (SELECT match_id, match_id % 300 - 150 AS h, match_id % 200 + 100 AS a FROM m WHERE match_id % 5 <> 0)
      SELECT match_id, 'book' AS provider, coalesce(round(CASE WHEN h > 0 THEN 100e0 / (h + 100) WHEN h < 0 THEN -h / CAST(100 - h AS DOUBLE) END, 4), -1) AS p_home, -1e0 AS p_draw, round(100e0 / (a + 100), 4) AS p_away,
        coalesce(round(CASE WHEN h > 0 THEN 1 + h / 100e0 WHEN h < 0 THEN 1 - 100e0 / h END, 3), -1) AS odds_home, -1e0 AS odds_draw, round(1 + a / 100e0, 3) AS odds_away FROM o""",
    "standings_scan": "SELECT s_nationkey AS league, 'Group ' || s_nationkey AS \"group\", CAST(CASE WHEN s_suppkey % 6 = 0 THEN 999 ELSE s_suppkey % 20 + 1 END AS INTEGER) AS rank, s_suppkey::VARCHAR AS team_id, s_name AS team, CAST(s_suppkey % 90 AS INTEGER) AS points FROM supplier",
    "season_matches": _SEASON + " SELECT competition, CAST(CAST(kickoff AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(hg) AS BIGINT) AS hg, CAST(sum(ag) AS BIGINT) AS ag FROM s GROUP BY 1, 2",
    "season_odds": _SEASON + " " + " UNION ALL ".join(f"SELECT '{b}' AS bookmaker, '{t}' AS timing, '{leg}' AS leg, count(*) AS n, round(sum(1.5e0 + (match_id % {10 * n}) / 10e0), 2) AS odds FROM s WHERE match_id % {n} <> 0" for b, t, leg, n in _QUOTES),
    "german_scan": "WITH " + FIXTURES_SQL + " SELECT match_id, CAST(epoch(kickoff) AS BIGINT) AS kickoff, 'T' || home_id AS home, 'T' || away_id AS away, CAST(hg AS INTEGER) AS hg, CAST(ag AS INTEGER) AS ag FROM fixtures WHERE src_status = 'F'",
    "game_events_scan": "SELECT CASE WHEN event_id % 5 = 0 THEN 'a' ELSE 'p' END || (event_id % 2) AS team, CASE WHEN event_id % 8 = 0 THEN 'Corner' WHEN event_id % 4 = 0 THEN 'Pass' WHEN event_id % 4 = 1 THEN 'Shot' ELSE 'Carry' END AS type, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 1) AS goals, coalesce(round(sum(CASE WHEN event_id % 4 = 1 THEN round(value / 1000, 3) END), 3), 0) AS xg FROM events GROUP BY 1, 2",
    "entity_scan": "SELECT n_nationkey, CAST(i AS INTEGER) AS position, 'Q' || i || n_nationkey AS entity_id, n_name AS label, CASE WHEN n_nationkey % 2 = i THEN lower(n_name) || '|x' ELSE '' END AS aliases FROM nation, (VALUES (0), (1)) t(i)",
    "all_sources": "SELECT 'feed' AS source, 'status' AS data_type, count(*) AS matches, 0 AS teams, count(DISTINCT o_orderstatus) AS \"values\" FROM orders UNION ALL SELECT 'feed', 'price', count(*), 0, count(DISTINCT o_totalprice) FROM orders UNION ALL SELECT 'registry', 'segment', 0, count(*), count(DISTINCT c_mktsegment) FROM customer",
    "stream_reference_marks": """WITH e AS (SELECT user_id AS match_id, ts, event_id, TIMESTAMP '2024-01-05 12:00:00' + to_days(CAST(user_id % 25 AS INTEGER)) AS kickoff FROM events), o AS (SELECT * FROM e WHERE ts < kickoff), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM o)
      SELECT match_id, arg_max(event_id, row(ts, event_id)) AS version FROM o, w WHERE ts <= kickoff - INTERVAL 15 MINUTE AND kickoff - INTERVAL 15 MINUTE < mark GROUP BY match_id""",
}
