"""Recency-weighted ratings, the Poisson model of goals, and the markets that follow from it. All of it is column arithmetic
and map-side aggregates; the score grid is an array in the row, so a forecast shuffles nothing but the ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.config import GOALS, ODDS, RATING
from foretide.functions.numbers import clamp, poisson_pmf, total


def sides(fixtures: DataFrame) -> DataFrame:
    """Each fixture as two rows, one from each side's view."""
    side = lambda loc, team, opp, gf, ga: F.struct(F.lit(loc).alias("loc"), F.col(team).alias("team_id"), F.col(opp).alias("opponent_id"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    rows = fixtures.select("match_id", "competition", "kickoff", F.explode(F.array(side("home", "home_id", "away_id", "hg", "ag"), side("away", "away_id", "home_id", "ag", "hg"))).alias("side"))
    return rows.select("match_id", "competition", "kickoff", "side.*").withColumn("result", F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L"))


def age_days(at: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), at.cast("date"))


def weight(at: Column, as_of: str) -> Column:
    """Half of it is lost in each half life."""
    return F.pow(F.lit(0.5), age_days(at, as_of) / F.lit(RATING.half_life_days))


def recent(fixtures: DataFrame, as_of: str) -> DataFrame:
    """Finished fixtures of the window before as_of (F01); a plain range on the kickoff, which reaches the scan."""
    start = F.date_sub(F.lit(as_of).cast("date"), RATING.window_days).cast("timestamp_ntz")
    return fixtures.filter((F.col("kickoff") >= start) & (F.col("kickoff") < F.lit(as_of).cast("timestamp_ntz")) & (F.col("hg") >= 0) & (F.col("ag") >= 0))


def team_rates(fixtures: DataFrame, as_of: str) -> DataFrame:
    """Weighted sums, results and points of each team of a competition."""
    w, at_home = F.col("w"), F.col("loc") == "home"
    rows = sides(recent(fixtures, as_of)).withColumn("w", weight(F.col("kickoff"), as_of))
    sums = {"n": F.count(F.lit(1)), "sw": F.sum(w), "gf": F.sum(w * F.col("gf")), "ga": F.sum(w * F.col("ga"))}
    for loc, here in (("home", at_home), ("away", ~at_home)):
        sums[f"{loc}_n"] = F.count_if(here)
        sums |= {f"{loc}_{k}": F.coalesce(F.sum(F.when(here, x)), F.lit(0.0)) for k, x in (("sw", w), ("gf", w * F.col("gf")), ("ga", w * F.col("ga")))}
    sums |= {k: F.count_if(F.col("result") == k.upper()) for k in "wdl"}
    out = rows.groupBy("competition", "team_id").agg(*[c.alias(k) for k, c in sums.items()])
    return out.withColumn("pts", 3 * F.col("w") + F.col("d"))


def team_slices(rates: DataFrame) -> DataFrame:
    """What is shown of a team (F20): its results, and goals for and against by weight of its games."""
    by_weight = lambda c: F.round(F.col(c) / F.greatest("sw", F.lit(0.01)), 2).alias(c)
    return rates.select("competition", "team_id", "n", "w", "d", "l", by_weight("gf"), by_weight("ga"))


def league_averages(fixtures: DataFrame, as_of: str) -> DataFrame:
    """Goals at home and away of each competition, within bounds."""
    rows = recent(fixtures, as_of).withColumn("w", weight(F.col("kickoff"), as_of))
    sw = F.sum("w")
    average = lambda goals, default, bounds: clamp(F.when(sw > 1, F.sum(F.col("w") * F.col(goals)) / sw).otherwise(F.lit(default)), *bounds)
    return rows.groupBy("competition").agg(
        F.count(F.lit(1)).alias("n"), average("hg", RATING.home_default, RATING.home_bounds).alias("home_avg"), average("ag", RATING.away_default, RATING.away_bounds).alias("away_avg")
    )


def _rate(prefix: str, loc: str, goals: str) -> Column:
    """Mostly the side's own rate where it has played enough (N03); null without weight."""
    c = lambda name: F.col(f"{prefix}_{name}")
    overall = c(goals) / c("sw")
    side = RATING.side_weight * c(f"{loc}_{goals}") / c(f"{loc}_sw") + (1 - RATING.side_weight) * overall
    enough = (c(f"{loc}_n") >= RATING.side_min_played) & (c(f"{loc}_sw") > RATING.side_min_weight)
    return F.when(c("sw") > RATING.min_weight, F.when(enough, side).otherwise(overall))


def _shrunk(rate: Column, average: Column, sw: Column) -> Column:
    return (F.coalesce(rate, average) * sw + average * RATING.shrink) / (sw + RATING.shrink)


def expected_goals(targets: DataFrame, rates: DataFrame, leagues: DataFrame) -> DataFrame:
    """lam_home, lam_away and reliab of the targets both of whose teams have a rating.

    Ratings are one row per team, joined twice without a hint: adaptive execution broadcasts them while they are small.
    Columns home_absences and away_absences count where they exist.
    """
    held = ["sw", "gf", "ga", *[f"{loc}_{k}" for loc in ("home", "away") for k in ("n", "sw", "gf", "ga")]]
    of = lambda p: rates.select("competition", F.col("team_id").alias(f"{p}_id"), *[F.col(k).alias(f"{p[0]}_{k}") for k in held])
    rows = targets.join(of("home"), ["competition", "home_id"]).join(of("away"), ["competition", "away_id"])
    rows = rows.join(leagues.select("competition", "home_avg", "away_avg"), "competition")
    home, away, h_sw, a_sw = F.col("home_avg"), F.col("away_avg"), F.col("h_sw"), F.col("a_sw")
    attack_h, defend_a = _shrunk(_rate("h", "home", "gf"), home, h_sw), _shrunk(_rate("a", "away", "ga"), away, a_sw)
    attack_a, defend_h = _shrunk(_rate("a", "away", "gf"), away, a_sw), _shrunk(_rate("h", "home", "ga"), home, h_sw)
    floor = lambda x: F.greatest(x, F.lit(0.5))
    lost = lambda c: 1 - GOALS.absence * F.least(F.lit(GOALS.absences_most), F.col(c)) if c in targets.columns else F.lit(1.0)
    lam_h = clamp(attack_h * defend_a / floor(away) * home / floor(home), *GOALS.home_bounds) * lost("home_absences")
    lam_a = clamp(attack_a * defend_h / floor(home) * away / floor(away), *GOALS.away_bounds) * lost("away_absences")
    reliab = F.least(F.lit(1.0), (h_sw + a_sw) / RATING.full_weight)
    return rows.select(*targets.columns, lam_h.alias("lam_home"), lam_a.alias("lam_away"), reliab.alias("reliab"))


def score_grid(forecast: DataFrame) -> DataFrame:
    """cells: an array of (h, a, p) for 0 to 10 goals a side (P06). It is cut off there and not scaled up again."""
    both = forecast.withColumn("home_pmf", poisson_pmf(F.col("lam_home"), GOALS.most_goals)).withColumn("away_pmf", poisson_pmf(F.col("lam_away"), GOALS.most_goals))
    cell = lambda x, i: F.transform("away_pmf", lambda y, j: F.struct(i.alias("h"), j.alias("a"), (x * y).alias("p")))
    return both.withColumn("cells", F.flatten(F.transform("home_pmf", cell))).drop("home_pmf", "away_pmf")


def outcome_probabilities(forecast: DataFrame) -> DataFrame:
    """p1, px, p2, over15, over25, over35, btts from the grid."""
    share = lambda test: total(F.transform(F.filter("cells", test), lambda c: c["p"]))
    goals = lambda n: share(lambda c: c["h"] + c["a"] > n)
    return score_grid(forecast).withColumns({
        "p1": share(lambda c: c["h"] > c["a"]), "px": share(lambda c: c["h"] == c["a"]), "p2": share(lambda c: c["h"] < c["a"]),
        "over15": goals(1), "over25": goals(2), "over35": goals(3), "btts": share(lambda c: (c["h"] > 0) & (c["a"] > 0)),
    })


def live_goals(forecast: DataFrame) -> DataFrame:
    """Expected goals of the time that is left, by minute and momentum (P05). Columns: minute, home_momentum, away_momentum."""
    left = (90 - clamp(F.col("minute"), 1, 90)) / 90.0
    push = lambda c: F.coalesce(clamp(0.35 + 1.3 * F.col(c), *GOALS.momentum_bounds), F.lit(1.0))
    scaled = lambda lam, m: F.when(left <= 0.01, F.lit(1e-6)).otherwise(F.col(lam) * left) * push(m)
    return forecast.withColumns({"lam_home": scaled("lam_home", "home_momentum"), "lam_away": scaled("lam_away", "away_momentum")})


def pick(p1: Column, px: Column, p2: Column) -> Column:
    return F.when((p1 >= px) & (p1 >= p2), "1").when(px >= p2, "N").otherwise("2")


def forecasts(fixtures: DataFrame, as_of: str) -> DataFrame:
    """The forecast of each fixture from as_of on, from those before it."""
    targets = fixtures.filter(F.col("kickoff") >= F.lit(as_of).cast("timestamp_ntz"))
    return outcome_probabilities(expected_goals(targets, team_rates(fixtures, as_of), league_averages(fixtures, as_of)))


def blended(forecast: DataFrame) -> DataFrame:
    """p1, px, p2 with the market's share (P07, N04). Columns: odds_home, odds_draw, odds_away as implied probabilities with margin."""
    raw = F.col("odds_home") + F.col("odds_draw") + F.col("odds_away")
    w = F.least(F.lit(ODDS.cap), ODDS.base + ODDS.extra * (1 - F.col("reliab")))
    mix = lambda p, o: F.when(raw > 0.5, (1 - w) * F.col(p) + w * F.col(o) / raw).otherwise(F.col(p))
    fair = lambda o: F.when(raw > 0.5, F.col(o) / raw)
    return forecast.withColumns({
        "market_1": fair("odds_home"), "market_x": fair("odds_draw"), "market_2": fair("odds_away"), "market_weight": F.when(raw > 0.5, w),
        "p1": mix("p1", "odds_home"), "px": mix("px", "odds_draw"), "p2": mix("p2", "odds_away"),
    })


def value_bets(blend: DataFrame) -> DataFrame:
    """side and edge where the model is surer than the market by far (P11, N09); the first of equal edges."""
    leg = lambda n, side, p, m: F.struct((F.col(p) - F.col(m)).alias("edge"), F.lit(-n).alias("order"), F.lit(side).alias("side"), F.col(p).alias("p"))
    legs = F.array(leg(0, "1", "p1", "market_1"), leg(1, "N", "px", "market_x"), leg(2, "2", "p2", "market_2"))
    best = F.array_max(F.filter(legs, lambda x: (x["edge"] >= ODDS.value_edge) & (x["p"] >= ODDS.value_least)))
    # as rows: a condition on a column goes down to the scan with all that the column is made of, the grid once for each time it is named
    rows = blend.select("*", F.explode_outer(F.array(best)).alias("value"))
    return rows.filter("value IS NOT NULL").withColumns({"value_side": F.col("value.side"), "value_edge": F.col("value.edge")}).drop("value")


#: The markets on display, in their order, with their kind and their probability.
MARKETS = (
    ("1", "p1", "1N2"), ("N", "px", "1N2"), ("2", "p2", "1N2"),
    ("1N", "p1 + px", "DC"), ("N2", "px + p2", "DC"), ("12", "p1 + p2", "DC"),
    ("over 1.5", "over15", "GOALS"), ("over 2.5", "over25", "GOALS"), ("under 2.5", "1 - over25", "GOALS"), ("under 3.5", "1 - over35", "GOALS"),
    ("both score", "btts", "BTTS"), ("not both score", "1 - btts", "BTTS"),
)


def market_board(forecast: DataFrame) -> DataFrame:
    """A row for each of the twelve markets."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("market"), F.lit(kind).alias("kind"), F.expr(p).alias("p")) for i, (name, p, kind) in enumerate(MARKETS)])
    return forecast.select("match_id", "reliab", F.explode(rows).alias("m")).select("match_id", "reliab", "m.*")


def safest_pick(forecast: DataFrame) -> DataFrame:
    """The market with the highest probability, the first of equals, and its stars."""
    rows = F.array(*[F.struct(F.expr(p).alias("p"), F.lit(-i).alias("order"), F.lit(name).alias("market"), F.lit(kind).alias("kind")) for i, (name, p, kind) in enumerate(MARKETS)])
    best = forecast.withColumn("best", F.array_max(rows))
    p = F.col("best.p")
    stars = F.when(p < 0.55, 1).when(p < 0.65, 2).when(p < 0.72, 3).when(p < 0.82, 4).otherwise(5)
    return best.select("match_id", F.col("best.market").alias("market"), F.col("best.kind").alias("kind"), p.alias("p"), stars.alias("stars"))


def confidence(forecast: DataFrame) -> DataFrame:
    """confidence and stars from 1 to 5 (P10)."""
    conf = (F.greatest("p1", "px", "p2") - 1 / 3) / (2 / 3) * (0.35 + 0.65 * F.col("reliab"))
    return forecast.withColumn("confidence", conf).withColumn("stars", clamp(F.round(1 + 4 * F.col("confidence")), 1, 5).cast("int"))


#: The market families and their selections.
FAMILIES = {
    "1N2": (("1", "p1"), ("N", "px"), ("2", "p2")),
    "DC": (("1N", "least(1e0, p1 + px)"), ("N2", "least(1e0, px + p2)"), ("12", "least(1e0, p1 + p2)")),
    "O1.5": (("PLUS", "over15"), ("MOINS", "1 - over15")),
    "O2.5": (("PLUS", "over25"), ("MOINS", "1 - over25")),
    "O3.5": (("PLUS", "over35"), ("MOINS", "1 - over35")),
    "BTTS": (("OUI", "btts"), ("NON", "1 - btts")),
}


def market_families(forecast: DataFrame, *keep: str) -> DataFrame:
    """A row for each family with its most probable selection (P13, H07): family, selection, p, and the three of 1N2."""
    leg = lambda i, s, p: F.struct(F.expr(p).alias("p"), F.lit(-i).alias("order"), F.lit(s).alias("selection"))
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.array_max(F.array(*[leg(i, s, p) for i, (s, p) in enumerate(legs)])).alias("best")) for f, legs in FAMILIES.items()])
    out = forecast.select("match_id", *keep, "p1", "px", "p2", F.explode(rows).alias("f"))
    return out.select("match_id", *keep, "p1", "px", "p2", F.col("f.family").alias("family"), F.col("f.best.selection").alias("selection"), F.col("f.best.p").alias("p"))
