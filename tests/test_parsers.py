"""Feeds of the shapes that sources give."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from foretide.functions import numbers, text, time
from foretide.operators import breaker, form, identity, ingestion, ledger, pit
from foretide.plans import feed_queries
from foretide.sources import access, parsers, sinks


def bodies(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "body_id long, body string")


def _event(home="Reds", state="post", score="2"):
    side = lambda where, name, points: {"homeAway": where, "score": points, "team": {"id": name[:1] + "1", "shortDisplayName": name}, "linescores": [{"value": 1.0}]}
    return {"id": "e1", "date": "2026-09-05T19:00Z", "status": {"type": {"state": state, "completed": True}}, "competitions": [{"venue": {"fullName": "Park"}, "competitors": [side("home", home, score), side("away", "Blues", "x")]}]}


def test_events(spark):
    got = parsers.events(bodies(spark, _event(), _event("TBD"), "{broken", "{}")).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.home_name, row.home_score, row.away_score, row.home_half, row.venue) == ("Reds", 2, None, 1, "Park")
    assert row.kickoff == datetime(2026, 9, 5, 19)


def test_summary(spark):
    body = {
        "boxscore": {"teams": [{"team": {"id": "1"}, "statistics": [{"name": "possession", "displayValue": "61.5%"}, {"name": "note", "displayValue": "n/a"}]}]},
        "keyEvents": [{"clock": {"displayValue": f"{i}'"}, "text": "GOAL by x" if i % 2 else "Yellow Card"} for i in range(30)],
        "pickcenter": [{"provider": {"name": "p"}, "homeTeamOdds": {"moneyLine": "-150"}, "awayTeamOdds": {"moneyLine": "300"}, "drawOdds": {"moneyLine": "0"}}],
    }
    df = bodies(spark, body)
    assert [(r.name, r.value) for r in parsers.statistics(df).collect()] == [("possession", 61.5)]
    lines = parsers.timeline(df).orderBy("position").collect()
    assert len(lines) == 25 and lines[0].icon == "goal" and lines[1].icon == "yellow"
    odds = parsers.moneylines(df).first()
    assert (round(odds.p_home, 3), odds.p_draw, round(odds.p_away, 3), odds.odds_home, odds.odds_away) == (0.6, None, 0.25, 1.667, 4.0)


def test_standings_weather_german_entities(spark):
    entry = lambda team, rank: {"team": {"id": team, "displayName": team}, "stats": [{"name": "rank", "displayValue": rank}, {"name": "points", "displayValue": "7"}]}
    table = parsers.standings(bodies(spark, {"children": [{"name": "A", "standings": {"entries": [entry("x", "2"), entry("y", "-")]}}]})).orderBy("rank").collect()
    assert [(r.team, r.rank, r.points) for r in table] == [("x", 2, 7), ("y", 999, 7)]
    hourly = {"hourly": {"time": ["2026-01-01T10:00", "2026-01-01T11:00"], "temperature_2m": [1.0, 2.0], "precipitation": [0.0, 0.5]}}
    current = {"current": {"time": "2026-01-01T09:00", "temperature_2m": 9.0, "precipitation": 0.1}}
    df = bodies(spark, hourly, current).withColumn("start", F.lit("2026-01-01 12:00:00").cast("timestamp"))
    assert [(r.temperature, r.gap, r.confidence) for r in parsers.weather(df, "start").orderBy("body_id").collect()] == [(2.0, True, "medium"), (9.0, False, "high")]
    match = {"matchID": 1, "matchDateTimeUTC": "2026-01-01T10:00:00Z", "team1": {"teamName": "a"}, "team2": {"teamName": "b"}, "matchIsFinished": True, "matchResults": [{"resultTypeID": 1, "resultName": "Halbzeit", "pointsTeam1": 0, "pointsTeam2": 0}, {"resultTypeID": 2, "resultName": "Endergebnis", "pointsTeam1": 3, "pointsTeam2": 1}]}
    assert [(r.hg, r.ag) for r in parsers.german_matches(bodies(spark, [match, {**match, "matchIsFinished": False}])).collect()] == [(3, 1)]
    found = parsers.entities(bodies(spark, {"search": [{"id": "Q1", "label": "l", "aliases": ["a", "b"]}, {"id": "Q2", "label": "m"}]})).orderBy("position").collect()
    assert [r.aliases for r in found] == ["a|b", ""]


def test_game_statistics(spark):
    shot = lambda team, xg, out: {"type": {"name": "Shot"}, "team": {"name": team}, "possession_team": {"name": team}, "shot": {"statsbomb_xg": xg, "outcome": {"name": out}}}
    foul = {"type": {"name": "Foul Committed"}, "team": {"name": "b"}, "possession_team": {"name": "a"}, "foul_committed": {"card": {"name": "Yellow Card"}}}
    df = bodies(spark, [shot("a", 0.4, "Goal"), shot("a", 0.25, "Saved"), shot("b", 0.43, "Off T"), foul]).withColumn("match_id", F.lit(1))
    got = {r.team: r for r in form.match_stats(parsers.game_events(df)).collect()}
    assert (got["a"].shots, got["a"].on_target, got["a"].xg, got["a"].fouls, got["a"].cards) == (2, 2, 0.65, 1, 1)
    assert (got["b"].shots, got["b"].on_target, got["b"].xg) == (1, 0, 0.43)
    acting = {r.team: r for r in form.match_stats(parsers.game_events(df, acting_team=True)).collect()}
    assert acting["b"].fouls == 1


def test_season_file(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("﻿Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,B365D,B365A,PSCH,PSCD,PSCA,PAHH\nE0,15/08/2025,Reds,Blues,4,2,H,1.5,4.2,7,1.48,4.3,7.1,9\nE0,16/08/25,,Blues,1,1,D,2,3,4,,,,\n", encoding="utf-8")
    rows = parsers.season_csv(spark, str(path))
    match = parsers.season_matches(rows).collect()
    assert [(m.competition, str(m.day), m.hg, m.ag, m.result) for m in match] == [("E0", "2025-08-15", 4, 2, "H")]
    odds = {(o.bookmaker, o.timing, o.leg): o.odds for o in parsers.season_odds(rows).collect()}
    assert odds["bet365", "opening", "H"] == 1.5 and odds["pinnacle", "closing", "A"] == 7.1 and len(odds) == 6


def test_windows_and_times(spark):
    rows = spark.createDataFrame([("a", "2026-01-02 10:00:00", 1, "x"), ("a", "2026-01-02 10:00:00", 2, "y"), ("b", "2026-01-05 00:00:00", 1, "z")], "event_id string, kickoff string, read_at long, v string").withColumn("kickoff", F.col("kickoff").cast("timestamp"))
    assert [(r.event_id, r.v) for r in parsers.window_of_events(rows, "2026-01-01", "2026-01-03").collect()] == [("a", "y")]
    chunks = spark.range(1).select(time.date_chunks("2026-01-01", "2026-01-10", 4).alias("c")).first().c
    assert [(str(c["first"]), str(c["last"])) for c in chunks] == [("2026-01-01", "2026-01-04"), ("2026-01-05", "2026-01-08"), ("2026-01-09", "2026-01-10")]
    season = spark.createDataFrame([("2026-09-01",), ("2027-02-01",)], "d string").select(time.season_code(F.col("d").cast("date")).alias("s")).collect()
    assert [r.s for r in season] == ["2627", "2627"]


def test_access(spark):
    sources = spark.createDataFrame([("a", "https://x.example", True, "active", {"xg": "true", "odds": "partial"}), ("b", "https://y.example", False, "active", {"xg": "unknown"})], "source_id string, base_url string, enabled boolean, status string, capabilities map<string,string>")
    urls = [("a", "https://www.x.example/p"), ("a", "http://x.example/"), ("a", "https://127.0.0.1/"), ("a", "https://z.example/"), ("b", "https://y.example/"), ("c", "https://x.example/"), ("a", "https://u:p@x.example/"), ("a", "https://x.example:8443/")]
    got = access.access(spark.createDataFrame(urls, "source_id string, url string"), sources).collect()
    assert {(r.source_id, r.url): r.reason for r in got} == dict(zip(urls, (None, "NOT_HTTPS", "INTERNAL_ADDRESS", "HOST_NOT_LISTED", "SOURCE_DISABLED", "UNKNOWN_SOURCE", "USERINFO", "PORT"), strict=True))
    assert [r.source_id for r in access.eligible(sources, "odds").collect()] == [] and [r.source_id for r in access.eligible(sources, "odds", ("true", "partial")).collect()] == ["a"]
    assert {r.source_id: r.reasons for r in access.rejections(sources, "xg").collect()} == {"b": ["DISABLED", "CAPABILITY_UNKNOWN"]}


def test_numbers_and_names(spark):
    one = spark.range(1)
    row = one.select(numbers.fair_odds(F.lit(0.4)).alias("f"), numbers.momentum(F.lit(3.0), F.lit(1.0), F.lit(60.0)).alias("m"), numbers.brier_binary(F.lit(0.7), F.lit(True)).alias("b"), F.round(numbers.poisson(F.lit(2), F.lit(1.5)), 6).alias("p")).first()
    assert (row.f, round(row.m, 4), round(row.b, 2), row.p) == (2.5, 0.6825, 0.18, 0.251021)
    names = spark.createDataFrame([("Paris Saint-Germain F.C.",), ("ÉTOILE  Ôrange",), ("FC",)], "n string").select(text.normal_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["paris saint germain f c", "etoile orange", "fc"]
    assert names.select(text.without_club_tokens(F.lit("fc")).alias("x")).first().x == "fc"


def _pair(spark, **change):
    base = {"a_event_id": 1, "b_event_id": 2, "a_source": "s", "b_source": "t", "a_external_id": "1", "b_external_id": "2", "a_competition": "c", "b_competition": "c", "a_kickoff": datetime(2026, 1, 1, 20), "b_kickoff": datetime(2026, 1, 1, 20, 10), "a_venue": "v", "b_venue": "v"}
    for p in "ab":
        for side, name in (("home", "alpha fc"), ("away", "bravo")):
            base |= {f"{p}_{side}_name": name, f"{p}_{side}_base": name.removesuffix(" fc"), f"{p}_{side}_id": None}
    base |= change
    kinds = {int: "long", str: "string", datetime: "timestamp", type(None): "string"}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items()))


def test_identity(spark):
    status = lambda **c: (lambda r: (r.status, r.reason, r.confidence))(identity.compare(_pair(spark, **c)).first())
    assert status() == ("MATCH_JOURNALIZED", "CONFIDENCE", 0.9)
    assert status(b_source="s", b_external_id="1")[0] == "MATCH_AUTO"
    assert status(b_source="s")[:2] == ("NO_MATCH", "EXTERNAL_ID_CONTRADICTION")
    assert status(b_kickoff=datetime(2026, 1, 4))[:2] == ("NO_MATCH", "DATE_DIFFERENT")
    assert status(a_home_name="paris", b_home_name="paris", a_home_base="paris", b_home_base="paris")[2] == 0.68
    assert status(a_home_name="alpha women")[1] == "CATEGORY_MISMATCH"
    turned = {"b_home_name": "bravo", "b_home_base": "bravo", "b_away_name": "alpha fc", "b_away_base": "alpha"}
    assert status(**turned) == ("UNKNOWN", "HOME_AWAY_INVERSION", 0.0)


def _decided(pairs) -> dict:
    """Pairs that are decided, inverted, near to a decision, or alike by the id or base of a side."""
    shared = [F.coalesce(F.col(f"a_{k}") == F.col(f"b_{k}"), F.lit(False)) for k in ("home_id", "home_base", "away_id", "away_base")]
    told = F.col("status").isin("MATCH_AUTO", "MATCH_JOURNALIZED") | (F.col("confidence") > 0.75) | (F.col("reason") == "HOME_AWAY_INVERSION")
    return {(r.a_event_id, r.b_event_id): (r.status, r.reason, r.confidence) for r in pairs.filter(told | shared[0] | shared[1] | shared[2] | shared[3]).collect()}


def _every(events, others):
    """Brute force: all pairs within a day."""
    a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for df, p in ((events, "a"), (others, "b")))
    days = F.abs(F.datediff(F.col("a_kickoff").cast("date"), F.col("b_kickoff").cast("date")))
    return identity.compare(a.crossJoin(b).filter(F.coalesce(days <= 1, F.lit(True))))


def test_candidates(spark):
    at = datetime(2026, 1, 1, 23, 50)
    long = "borussia verein fuer leibesuebungen"
    left = [(1, "s", "1", "alpha one", "bravo", "c", at, None), (2, "s", "2", "wien", "graz", "c", at, None), (3, "s", "3", "xx", "yy", "c", at, None), (4, "s", "4", long, f"{long} two", "c", at, "v"), (5, "s", "5", "kilo", "lima", "c", None, "w")]
    right = [
        (11, "t", "9", "team alpha 1 fc", "bravo", "c", datetime(2026, 1, 2, 0, 10), "v"), (12, "t", "8", "graz", "wien", "c", at, None), (13, "s", "3", "xy", "yx", "c", at, None),
        (14, "t", "7", f"{long}s", f"{long}s two", "c", at, "v"), (15, "s", "5", "kilo", "lima", "c", at, "w"), (16, "t", "6", "team alpha 1", "golf", "c", at, None), (17, "t", "5", "", "", "c", at, None),
    ]
    book = identity.alias_book(spark.createDataFrame([("Alpha One", "t1", 0), ("Team Alpha 1", "t1", 1)], "alias string, canonical_id string, position int"))
    kinds = "event_id long, source string, external_id string, home string, away string, competition string, kickoff timestamp, venue string"
    a, b = (identity.with_canonical(spark.createDataFrame(rows, kinds), book) for rows in (left, right))
    got, want = identity.compare(identity.candidates(a, b)), _decided(_every(a, b))
    assert _decided(got) == want and got.count() < len(left) * len(right) / 2
    assert {k: v[1:] for k, v in want.items()}[2, 12] == ("HOME_AWAY_INVERSION", 0.0) and (1, 16) in want and (4, 14) in want and (5, 15) in want
    known = identity.with_canonical(spark.createDataFrame([(1, "s", "1", "team alpha 1", "x", "c", at, None)], kinds), book)
    unknown = identity.with_canonical(spark.createDataFrame([(2, "t", "2", "team alpha 1 fc", "y", "c", at, None)], kinds), book)
    assert identity.candidates(known, unknown).count() == 1  # the id of one doesn't hide the base


def test_identity_takes_all_orders(spark, sf):
    """The registered query against all pairs within a day, over all orders."""
    book = identity.alias_book(spark.createDataFrame([("Team Alpha 1", "t1", 0), ("Alpha One", "t1", 1), ("Team Bravo 2", "t2", 2)], "alias string, canonical_id string, position int"))
    rows = identity.with_canonical(feed_queries.team_events(spark, sf), book)
    want = _decided(_every(rows.filter("source = 's0'"), rows.filter("source = 's1'")))
    got = {(r.a_event_id, r.b_event_id): (r.status, r.reason, r.confidence) for r in feed_queries.identity_scores(spark, sf).collect()}
    assert rows.count() == 2 * spark.read.parquet(f"{sf}/orders.parquet").count()
    assert got == want and len({a // 2 % 11 for a, _ in got}) == 11


def test_breaker_and_caps(spark):
    calls = spark.createDataFrame([("s", i, i * 10, False) for i in range(7)] + [("s", 7, 3000, True), ("s", 8, 3010, False)], "source string, call_id long, at_seconds long, ok boolean")
    states = [r.state for r in breaker.circuit_breaker(calls).orderBy("call_id").collect()]
    assert states == ["CLOSED"] * 5 + ["REFUSED"] * 2 + ["HALF_OPEN", "CLOSED"]


def test_store(spark):
    points = spark.createDataFrame([(1, "m", "score_live", "a", "2026-01-01 11:10:00", None, 1.0, "high"), (2, "m", "score_live", "b", "2026-01-01 12:00:00", None, 2.0, "high"), (3, "m", "score_live", "b", "2026-01-01 13:00:00", "2026-01-01 10:00:00", None, "low")], "point_id long, match_id string, data_type string, source string, retrieved_at string, effective_at string, value double, confidence string")
    points = points.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("retrieved_at", "effective_at")}).withColumn("is_unknown", F.col("value").isNull())
    at = lambda t: [r.point_id for r in pit.latest_as_of(points, t, "match_id", "data_type").collect()]
    assert at("2026-01-01 12:00:00") == [2] and at("2026-01-01 11:10:00") == [1] and at("2026-01-01 09:00:00") == []
    fresh = pit.freshness(points, "2026-01-01 12:00:20", pit.ttl_seconds(F.col("data_type"))).orderBy("point_id").collect()
    assert [r.freshness for r in fresh] == ["stale", "fresh", "fresh"]
    chain = pit.priority_table(spark, ["b", "a"])
    assert pit.resolve_conflicts(points, chain, "match_id").first().decision == "PRIORITY_SOURCE"
    tied = points.filter("point_id < 3").withColumns({"source": F.lit("a"), "retrieved_at": F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")})
    assert pit.resolve_conflicts(tied, chain, "match_id").first().decision == "UNKNOWN_CRITICAL_CONFLICT"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, at long, v string")
    path = str(tmp_path / "t")
    sinks.append_new(rows, path, ["k"], ["at"])
    sinks.append_new(rows.withColumn("k", F.col("k") + 1), path, ["k"], ["at"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "c")]
    assert sinks.backup(spark, path, str(tmp_path / "copy")) == 3
    assert ledger.latest(rows, ["k"], [F.desc("at")]).count() == 2
