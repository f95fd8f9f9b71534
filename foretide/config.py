"""Settings of the model, the ledger and the store."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rating:
    window_days: int = 150
    half_life_days: float = 70.0
    shrink: float = 3.0
    side_weight: float = 0.65
    side_min_played: int = 3
    side_min_weight: float = 0.3
    min_weight: float = 0.05
    home_default: float = 1.45
    home_bounds: tuple[float, float] = (0.9, 2.3)
    away_default: float = 1.10
    away_bounds: tuple[float, float] = (0.7, 2.0)
    full_weight: float = 14.0


@dataclass(frozen=True)
class Goals:
    home_bounds: tuple[float, float] = (0.15, 4.5)
    away_bounds: tuple[float, float] = (0.10, 4.0)
    absence: float = 0.025
    absences_most: int = 4
    most_goals: int = 10
    momentum_bounds: tuple[float, float] = (0.5, 1.75)


@dataclass(frozen=True)
class Odds:
    base: float = 0.25
    extra: float = 0.45
    cap: float = 0.65
    value_edge: float = 0.08
    value_least: float = 0.35


@dataclass(frozen=True)
class Evaluation:
    least_sample: int = 20
    roi_least: int = 5
    bins: int = 10
    epsilon: float = 1e-12


@dataclass(frozen=True)
class Identity:
    auto: float = 0.95
    journalised: float = 0.80
    margin: float = 0.05
    strong: float = 0.96
    weak: float = 0.85
    ambiguous: float = 0.5


RATING, GOALS, ODDS, EVALUATION, IDENTITY = Rating(), Goals(), Odds(), Evaluation(), Identity()

#: Seconds for which an observation of a type stays fresh; None means it never expires.
TTL_SECONDS: dict[str, int | None] = {"score_live": 30, "odds": 300, "lineups": 300, "match_calendar": 900, "injuries": 1800, "standings": 7200, "weather": 10800, "historical_results": None}

#: Weights of evidence that two events are the same.
EVIDENCE = {"external_id": 0.35, "home": 0.22, "away": 0.22, "competition": 0.13, "date": 0.14, "time": 0.09, "stadium": 0.10}
QUALITY = {"reliability": 0.30, "freshness": 0.25, "confirmation": 0.20, "temporal": 0.15, "completeness": 0.10}
CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.3, "unknown": 0.0}
#: Phases by minutes to the start.
PHASES = ((15, "T-15"), (60, "T-60"), (180, "T-180"))
