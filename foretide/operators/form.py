"""Form of teams: last results, streaks, and meetings of two teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last_first() -> list[Column]:
    return [F.desc("kickoff"), F.desc("match_id")]


def last_n(sides: DataFrame, n: int, by: str = "team_id") -> DataFrame:
    """The last n games of each team with their rank (W01); what is beyond n goes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*_last_first()))
    return sides.withColumn("rn", rank).filter(F.col("rn") <= n)


def _letters() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "result"))), lambda x: x["result"]), "")


def form(sides: DataFrame, n: int, loc: str | None = None) -> DataFrame:
    """Played, results, goals, clean sheets, both scored, over and under 2.5, letters, complete (A05); loc: home or away only."""
    rows = last_n(sides.filter(F.col("loc") == loc) if loc else sides, n)
    goals = F.col("gf") + F.col("ga")
    return rows.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("played"), *[F.count_if(F.col("result") == r).alias(k) for r, k in (("W", "wins"), ("D", "draws"), ("L", "losses"))], F.sum("gf").alias("gf"), F.sum("ga").alias("ga"),
        F.count_if(F.col("ga") == 0).alias("clean_sheets"), F.count_if((F.col("gf") > 0) & (F.col("ga") > 0)).alias("btts"), F.count_if(goals > 2).alias("over25"), F.count_if(goals <= 2).alias("under25"),
        _letters().alias("form"), (F.count(F.lit(1)) >= n).alias("sample_complete"),
    )


def form_array(sides: DataFrame, n: int = 6) -> DataFrame:
    """The last n games as text, the latest first."""
    game = F.concat_ws(":", "result", F.col("gf").cast("string"), F.col("ga").cast("string"), "loc")
    rows = last_n(sides, n).withColumn("game", game)
    return rows.groupBy("team_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "game"))), lambda x: x["game"]), ",").alias("games"))


def streak(sides: DataFrame) -> DataFrame:
    """The current run of equal results, as W3 (A06, W09): the first game that differs ends it.

    The latest result of a team is one aggregate, and what differs from it another; no team's games are put in one row.
    """
    key = F.struct("kickoff", "match_id")
    now = sides.groupBy("team_id").agg(F.max_by("result", key).alias("now"))
    rows = sides.join(now, "team_id")
    ends = rows.groupBy("team_id", "now").agg(F.max(F.when(F.col("result") != F.col("now"), key)).alias("end"))
    rows = sides.join(ends, "team_id").filter(F.col("end").isNull() | (F.struct("kickoff", "match_id") > F.col("end")))
    return rows.groupBy("team_id", "now").agg(F.count(F.lit(1)).alias("length")).select("team_id", F.concat("now", F.col("length").cast("string")).alias("streak"))


def head_to_head(fixtures: DataFrame, n: int = 10) -> DataFrame:
    """The last n meetings of each unordered pair, wins of the smaller id's side and of the other."""
    low = F.least("home_id", "away_id")
    ahead = F.when(F.col("hg") == F.col("ag"), 0).when((F.col("hg") > F.col("ag")) == (F.col("home_id") == low), 1).otherwise(-1)
    rows = fixtures.withColumns({"team_a": low, "team_b": F.greatest("home_id", "away_id"), "ahead": ahead})
    rank = F.row_number().over(Window.partitionBy("team_a", "team_b").orderBy(*_last_first()))
    rows = rows.withColumn("rn", rank).filter(F.col("rn") <= n)
    count = lambda x, name: F.count_if(F.col("ahead") == x).alias(name)
    return rows.groupBy("team_a", "team_b").agg(F.count(F.lit(1)).alias("meetings"), count(1, "wins_a"), count(0, "draws"), count(-1, "wins_b"))


def match_stats(events: DataFrame) -> DataFrame:
    """Counts by team of a stream of events (A09, T15): columns match_id, team, type, outcome, card, xg. xg null where no shot has one."""
    shot = F.col("type") == "Shot"
    return events.groupBy("match_id", "team").agg(
        F.count_if(shot).alias("shots"), F.count_if(shot & F.col("outcome").isin("Goal", "Saved", "Saved To Post")).alias("on_target"), F.round(F.sum(F.when(shot, F.col("xg"))), 3).alias("xg"),
        F.count_if(F.col("type") == "Foul Committed").alias("fouls"), F.count_if(F.col("card").isNotNull()).alias("cards"), F.count_if(F.col("type") == "Corner").alias("corners"),
    )
