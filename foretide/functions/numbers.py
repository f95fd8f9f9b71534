"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretide.config import EVALUATION


def clamp(x: Column, low: float, high: float) -> Column:
    """N05."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def poisson(k: Column, lam: Column) -> Column:
    """N01, P17."""
    return F.exp(-lam) * F.pow(lam, k) / F.factorial(k.cast("int"))


def poisson_pmf(lam: Column, most: int) -> Column:
    """The probabilities of 0 to `most`."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: poisson(k, lam))


def shrink(value: Column, toward: Column, sw: Column, k: float) -> Column:
    """N02."""
    return (value * sw + toward * k) / (sw + k)


def american_probability(line: Column) -> Column:
    """Implied probability of American odds; null at zero."""
    x = line.try_cast("double")
    return F.when(x > 0, 100 / (x + 100)).when(x < 0, -x / (100 - x))


def american_decimal(line: Column) -> Column:
    x = line.try_cast("double")
    return F.when(x > 0, F.round(1 + x / 100, 3)).when(x < 0, F.round(1 - 100 / x, 3))


def fair_odds(p: Column) -> Column:
    """N06."""
    return F.round(1 / F.greatest(p, F.lit(1e-9)), 3)


def safe_double(text: Column) -> Column:
    """Null where it is no number."""
    return text.try_cast("double")


def safe_int(text: Column) -> Column:
    """By way of a double, cut toward zero."""
    return text.try_cast("double").try_cast("int")


def brier_binary(p: Column, won: Column) -> Column:
    """N07 for a selection that wins or not: from 0 to 2."""
    o = F.when(won, 1.0).otherwise(0.0)
    return F.pow(p - o, F.lit(2)) + F.pow((1 - p) - (1 - o), F.lit(2))


def log_loss(p: Column, epsilon: float = EVALUATION.epsilon) -> Column:
    """Of the probability given to what happened, kept away from 0 and 1."""
    return -F.log(clamp(p, epsilon, 1.0))


def momentum(home: Column, away: Column, home_possession: Column) -> Column:
    """The home side's share of a game, by attacks and possession."""
    attack = F.when(home + away > 0, home / (home + away)).otherwise(F.lit(0.5))
    return clamp(0.55 * attack + 0.45 * F.coalesce(home_possession / 100, F.lit(0.5)), 0.05, 0.95)


def round_half_even(x: Column, places: int) -> Column:
    """Of a number's binary value, with a tie to the even side (N11): what scaling by a power of ten rounds away is computed
    from the halves of x's digits, and decides where the scaled value seems to lie on a half."""
    scale = 10.0**places
    wide = x * 134217729.0  # 2^27 + 1 cuts a double into two halves of its digits
    high = wide - (wide - x)
    scaled = x * scale
    lost = (high * scale - scaled) + (x - high) * scale
    low = F.floor(scaled).cast("double")
    over = (scaled - low - 0.5) + lost
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    return F.when(up, low + 1).otherwise(low) / scale
