"""Feeds as DataFrames: each parser takes a table with a text column and gives typed rows. Schemas are stated, never inferred; rows
that cannot be read give nulls and are told by readable()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions.numbers import american_decimal, american_probability, safe_int
from foretide.functions.text import timeline_icon
from foretide.functions.time import parse_day, parse_instant

_COMPETITOR = "STRUCT<homeAway:STRING,score:STRING,team:STRUCT<id:STRING,displayName:STRING,shortDisplayName:STRING,name:STRING>,linescores:ARRAY<STRUCT<value:DOUBLE>>>"
EVENT = f"STRUCT<id:STRING,date:STRING,status:STRUCT<clock:DOUBLE,displayClock:STRING,type:STRUCT<state:STRING,completed:BOOLEAN,detail:STRING>>,competitions:ARRAY<STRUCT<venue:STRUCT<fullName:STRING>,competitors:ARRAY<{_COMPETITOR}>>>>"
SUMMARY = "STRUCT<boxscore:STRUCT<teams:ARRAY<STRUCT<team:STRUCT<id:STRING>,statistics:ARRAY<STRUCT<name:STRING,displayValue:STRING>>>>>,keyEvents:ARRAY<STRUCT<clock:STRUCT<displayValue:STRING>,text:STRING>>,pickcenter:ARRAY<STRUCT<provider:STRUCT<name:STRING>,homeTeamOdds:STRUCT<moneyLine:STRING>,awayTeamOdds:STRUCT<moneyLine:STRING>,drawOdds:STRUCT<moneyLine:STRING>>>>"
STANDINGS = "STRUCT<children:ARRAY<STRUCT<name:STRING,standings:STRUCT<entries:ARRAY<STRUCT<team:STRUCT<id:STRING,displayName:STRING>,stats:ARRAY<STRUCT<name:STRING,displayValue:STRING>>>>>>>>"
WEATHER = "STRUCT<current:STRUCT<time:STRING,temperature_2m:DOUBLE,precipitation:DOUBLE>,hourly:STRUCT<time:ARRAY<STRING>,temperature_2m:ARRAY<DOUBLE>,precipitation:ARRAY<DOUBLE>>>"
GERMAN = "ARRAY<STRUCT<matchID:BIGINT,matchDateTimeUTC:STRING,team1:STRUCT<teamName:STRING>,team2:STRUCT<teamName:STRING>,matchIsFinished:BOOLEAN,matchResults:ARRAY<STRUCT<resultTypeID:INT,resultName:STRING,pointsTeam1:INT,pointsTeam2:INT>>>>"
GAME_EVENTS = "ARRAY<STRUCT<type:STRUCT<name:STRING>,team:STRUCT<name:STRING>,possession_team:STRUCT<name:STRING>,shot:STRUCT<statsbomb_xg:DOUBLE,outcome:STRUCT<name:STRING>>,foul_committed:STRUCT<card:STRUCT<name:STRING>>,pass:STRUCT<type:STRUCT<name:STRING>>>>"
ENTITIES = "STRUCT<search:ARRAY<STRUCT<id:STRING,label:STRING,description:STRING,aliases:ARRAY<STRING>>>>"


def readable(text: Column) -> Column:
    """Whether a body is JSON at all."""
    return F.try_parse_json(text).isNotNull()


def _of_side(competitors: Column, side: str) -> Column:
    return F.get(F.filter(competitors, lambda c: c["homeAway"] == side), F.lit(0))


def events(bodies: DataFrame, column: str = "body") -> DataFrame:
    """One row for each event (S03, Z19): sides without an id, or not yet decided, drop the event."""
    e = bodies.select(*[c for c in bodies.columns if c != column], F.from_json(column, EVENT).alias("e")).withColumn("c", F.get("e.competitions", F.lit(0)))
    for side in ("home", "away"):
        e = e.withColumn(side, _of_side(F.col("c.competitors"), side))
    name = lambda s: F.coalesce(F.col(f"{s}.team.shortDisplayName"), F.col(f"{s}.team.displayName"), F.col(f"{s}.team.name"))
    parts = [[F.col(f"{s}.team.id").alias(f"{s}_id"), name(s).alias(f"{s}_name"), safe_int(F.col(f"{s}.score")).alias(f"{s}_score"), F.get(f"{s}.linescores", F.lit(0))["value"].cast("int").alias(f"{s}_half")] for s in ("home", "away")]
    kept = [c for c in bodies.columns if c != column]
    out = e.select(*kept, F.col("e.id").alias("event_id"), parse_instant(F.col("e.date")).alias("kickoff"), F.col("e.status.type.state").alias("state"), F.coalesce("e.status.type.completed", F.lit(False)).alias("completed"), *parts[0], *parts[1], F.col("c.venue.fullName").alias("venue"))
    return out.filter("home_id IS NOT NULL AND away_id IS NOT NULL").filter(~F.upper("home_name").isin("TBD", "TBA") & ~F.upper("away_name").isin("TBD", "TBA"))


def window_of_events(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Events of the days from first to last, each once: the one read last (S01, K01). Columns event_id, kickoff, read_at."""
    inside = rows.filter(F.col("kickoff").cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rest = [c for c in rows.columns if c != "event_id"]
    return inside.groupBy("event_id").agg(F.max_by(F.struct(*rest), "read_at").alias("row")).select("event_id", "row.*")


def statistics(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Figures by team in long form."""
    s = bodies.withColumn("s", F.from_json(column, SUMMARY)).drop(column)
    teams = s.withColumn("t", F.explode("s.boxscore.teams")).withColumn("x", F.explode("t.statistics"))
    value = F.regexp_replace("x.displayValue", "%", "").try_cast("double")
    return teams.select(*[c for c in bodies.columns if c != column], F.col("t.team.id").alias("team_id"), F.col("x.name").alias("name"), value.alias("value")).filter("value IS NOT NULL")


def timeline(bodies: DataFrame, column: str = "body", last: int = 25) -> DataFrame:
    """The last entries with their icon."""
    s = bodies.withColumn("k", F.from_json(column, SUMMARY)["keyEvents"]).drop(column)
    tail = F.slice("k", F.greatest(F.size("k") - last + 1, F.lit(1)), F.lit(last))
    rows = s.withColumn("k", tail).select(*[c for c in bodies.columns if c != column], F.posexplode("k").alias("position", "entry"))
    return rows.select(*[c for c in bodies.columns if c != column], "position", F.col("entry.clock.displayValue").alias("clock"), F.col("entry.text").alias("text"), timeline_icon(F.col("entry.text")).alias("icon"))


def moneylines(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Odds of the first provider as probabilities and decimals."""
    s = bodies.withColumn("o", F.get(F.from_json(column, SUMMARY)["pickcenter"], F.lit(0))).drop(column).filter("o IS NOT NULL")
    legs = {"home": "o.homeTeamOdds.moneyLine", "draw": "o.drawOdds.moneyLine", "away": "o.awayTeamOdds.moneyLine"}
    return s.select(*[c for c in bodies.columns if c != column], F.col("o.provider.name").alias("provider"), *[american_probability(F.col(p)).alias(f"p_{k}") for k, p in legs.items()], *[american_decimal(F.col(p)).alias(f"odds_{k}") for k, p in legs.items()])


def standings(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Entries by rank; those without one last."""
    s = bodies.withColumn("g", F.explode(F.from_json(column, STANDINGS)["children"])).drop(column).withColumn("x", F.explode("g.standings.entries"))
    stats = F.map_from_entries(F.transform(F.array_distinct(F.transform("x.stats", lambda y: y["name"])), lambda n: F.struct(n, F.filter("x.stats", lambda y: y["name"] == n)[0]["displayValue"])))
    rows = s.withColumn("stats", stats)
    rank = F.coalesce(F.element_at("stats", F.lit("rank")).try_cast("int"), F.lit(999))
    return rows.select(*[c for c in bodies.columns if c != column], F.col("g.name").alias("group"), rank.alias("rank"), F.col("x.team.id").alias("team_id"), F.col("x.team.displayName").alias("team"), F.element_at("stats", F.lit("points")).try_cast("int").alias("points"))


def datapoints(rows: DataFrame, key: list[str], fields: dict[str, str], source: str, at: Column) -> DataFrame:
    """Wide rows as long ones, without those that hold nothing (S06, S07, S09, S16): data_type, value, source, retrieved_at."""
    parts = F.array(*[F.struct(F.lit(t).alias("data_type"), F.col(c).cast("string").alias("value")) for t, c in fields.items()])
    out = rows.select(*key, F.explode(F.filter(parts, lambda p: p["value"].isNotNull())).alias("p"))
    return out.select(*key, "p.*", F.lit(source).alias("source"), at.alias("retrieved_at"))


def all_points(*frames: DataFrame) -> DataFrame:
    """U01, S28."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def expected_but_missing(points: DataFrame, matches: DataFrame, types: list[str]) -> DataFrame:
    """A row of its own for each type that was asked for and not given."""
    wanted = matches.select("match_id", F.explode(F.array(*map(F.lit, types))).alias("data_type"))
    return wanted.join(points.select("match_id", "data_type").distinct(), ["match_id", "data_type"], "left_anti").withColumn("is_unknown", F.lit(True))


def weather(bodies: DataFrame, target: str, column: str = "body") -> DataFrame:
    """The current weather, else the hour nearest to a start (S11, H08): target names a column with the instant."""
    w = bodies.withColumn("w", F.from_json(column, WEATHER)).drop(column)
    slots = F.transform(F.arrays_zip("w.hourly.time", "w.hourly.temperature_2m", "w.hourly.precipitation"), lambda s: F.struct(F.abs(F.unix_seconds(parse_instant(s["time"])) - F.unix_seconds(F.col(target).cast("timestamp"))).alias("off"), s["time"].alias("time"), s["temperature_2m"].alias("temperature"), s["precipitation"].alias("precipitation")))
    best = F.array_min(F.filter(slots, lambda s: s["off"].isNotNull()))
    now = F.col("w.current")
    far = now.isNull() & (best["off"] > 1800)
    kept = [c for c in bodies.columns if c != column]
    return w.select(*kept, F.coalesce(now["time"], best["time"]).alias("slot"), F.coalesce(now["temperature_2m"], best["temperature"]).alias("temperature"), F.coalesce(now["precipitation"], best["precipitation"]).alias("precipitation"), F.coalesce(far, F.lit(False)).alias("gap"), F.when(far, "medium").otherwise("high").alias("confidence"))


def german_matches(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Finished matches with their final result, the last of those marked as such."""
    m = bodies.select(F.explode(F.from_json(column, GERMAN)).alias("m")).filter("m.matchIsFinished")
    final = F.filter("m.matchResults", lambda r: (r["resultTypeID"] == 2) | F.lower(r["resultName"]).startswith("end"))
    end = F.try_element_at(final, F.lit(-1))
    return m.select(F.col("m.matchID").alias("match_id"), parse_instant(F.col("m.matchDateTimeUTC")).alias("kickoff"), F.col("m.team1.teamName").alias("home"), F.col("m.team2.teamName").alias("away"), end["pointsTeam1"].alias("hg"), end["pointsTeam2"].alias("ag"))


def game_events(bodies: DataFrame, acting_team: bool = False, column: str = "body") -> DataFrame:
    """Rows for match_stats() (S13, A09, T15): a game's events go to the team in possession, or to the acting one."""
    e = bodies.select(*[c for c in bodies.columns if c != column], F.explode(F.from_json(column, GAME_EVENTS)).alias("e"))
    order = ("e.team.name", "e.possession_team.name") if acting_team else ("e.possession_team.name", "e.team.name")
    kind = F.when(F.col("e.pass.type.name") == "Corner", "Corner").otherwise(F.col("e.type.name"))
    return e.select(*[c for c in bodies.columns if c != column], F.coalesce(*order).alias("team"), kind.alias("type"), F.col("e.shot.outcome.name").alias("outcome"), F.col("e.foul_committed.card.name").alias("card"), F.col("e.shot.statsbomb_xg").alias("xg"))


def entities(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Candidates of an entity search with their aliases."""
    s = bodies.select(*[c for c in bodies.columns if c != column], F.posexplode(F.from_json(column, ENTITIES)["search"]).alias("position", "s"))
    return s.select(*[c for c in bodies.columns if c != column], "position", F.col("s.id").alias("entity_id"), F.col("s.label").alias("label"), F.array_join(F.coalesce("s.aliases", F.array().cast("array<string>")), "|").alias("aliases"))


LINEUPS = "STRUCT<rosters:ARRAY<STRUCT<team:STRUCT<id:STRING>,roster:ARRAY<STRUCT<starter:BOOLEAN,jersey:STRING,athlete:STRUCT<displayName:STRING>>>>>>"
CLAIMS = "STRUCT<claims:MAP<STRING,ARRAY<STRUCT<mainsnak:STRUCT<datavalue:STRUCT<value:STRING>>>>>>"


def lineups(bodies: DataFrame, column: str = "body", starters: int = 11, others: int = 12) -> DataFrame:
    """Names of the first eleven and twelve others of each team, in the order given."""
    r = bodies.select(*[c for c in bodies.columns if c != column], F.explode(F.from_json(column, LINEUPS)["rosters"]).alias("r"))
    names = lambda which, n: F.slice(F.transform(F.filter("r.roster", which), lambda p: p["athlete"]["displayName"]), 1, n)
    first, rest = (lambda p: F.coalesce(p["starter"], F.lit(False))), (lambda p: ~F.coalesce(p["starter"], F.lit(False)))
    return r.select(*[c for c in bodies.columns if c != column], F.col("r.team.id").alias("team_id"), names(first, starters).alias("starters"), names(rest, others).alias("substitutes"))


def first_claims(bodies: DataFrame, properties: list[str], column: str = "body") -> DataFrame:
    """A column for each property with the first of its claims that has a value (Z20): an id, else an amount, else a plain value."""
    c = bodies.select(*[c for c in bodies.columns if c != column], F.from_json(column, CLAIMS)["claims"].alias("claims"))

    def value(claim: Column) -> Column:
        raw = claim["mainsnak"]["datavalue"]["value"]
        of = lambda key: F.get_json_object(raw, f"$.{key}")
        return F.when(raw.startswith("{"), F.coalesce(of("id"), of("amount"))).otherwise(raw)

    first = lambda p: F.get(F.filter(F.transform(F.coalesce(F.try_element_at("claims", F.lit(p)), F.array()), value), lambda v: v.isNotNull()), F.lit(0))
    return c.select(*[x for x in bodies.columns if x != column], *[first(p).alias(p) for p in properties])


def properties(bodies: DataFrame, column: str = "body") -> DataFrame:
    """The keys of objects in long form (H03): key, value as text, and number where it is one; bodies that can't be read have a row
    without a key."""
    held = F.from_json(column, "MAP<STRING,STRING>")
    rows = bodies.withColumn("readable", F.coalesce(readable(F.col(column)), F.lit(False)))
    out = rows.select(*[c for c in bodies.columns if c != column], "readable", F.explode_outer(F.when(F.col("readable"), held)).alias("key", "value"))
    return out.filter("key IS NOT NULL OR NOT readable").withColumn("number", F.col("value").try_cast("double"))


#: Bookmakers by the letters of their columns.
BOOKMAKERS = {"B365": "bet365", "BW": "bwin", "IW": "interwetten", "PS": "pinnacle", "WH": "william hill", "VC": "victor chandler", "Max": "best", "Avg": "average"}


def season_csv(spark: SparkSession, path: str) -> DataFrame:
    """A season's file by its header, all columns as text; a byte order mark is dropped."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def season_matches(rows: DataFrame) -> DataFrame:
    """Matches of a season's file; rows without teams go."""
    return rows.filter("HomeTeam IS NOT NULL AND AwayTeam IS NOT NULL").select(F.col("Div").alias("competition"), parse_day(F.col("Date")).alias("day"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"), safe_int(F.col("FTHG")).alias("hg"), safe_int(F.col("FTAG")).alias("ag"), F.col("FTR").alias("result"))


def season_odds(rows: DataFrame) -> DataFrame:
    """1X2 quotes in long form by bookmaker and time (X16, T13, T21): handicaps and totals are no quotes of this kind."""
    legs = [(f"{code}{closing}{leg}", name, "closing" if closing else "opening", leg) for code, name in BOOKMAKERS.items() for closing in ("", "C") for leg in "HDA"]
    held = sorted(x for x in legs if x[0] in rows.columns)
    parts = F.array(*[F.struct(F.lit(name).alias("bookmaker"), F.lit(timing).alias("timing"), F.lit(leg).alias("leg"), F.col(c).try_cast("double").alias("odds")) for c, name, timing, leg in held])
    key = [F.col("Div").alias("competition"), parse_day(F.col("Date")).alias("day"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away")]
    return rows.filter("HomeTeam IS NOT NULL AND AwayTeam IS NOT NULL").select(*key, F.explode(F.filter(parts, lambda p: p["odds"].isNotNull())).alias("q")).select("competition", "day", "home", "away", "q.*")


def requests(matches: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The list of what is to be fetched (S27): a template's {name} stands for a column of matches."""
    url = lambda t: reduce(lambda out, c: F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit(""))), matches.columns, F.lit(t))
    parts = F.array(*[F.struct(F.lit(s).alias("source"), url(t).alias("url")) for s, t in templates.items()])
    return matches.select("match_id", F.explode(parts).alias("r")).select("match_id", "r.*")
