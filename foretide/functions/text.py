"""Text as column expressions. Only folding of accents and the similarity of two names need Python, as pandas UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of clubs' names that say nothing.
CLUB_TOKENS = (
    "fc", "cf", "afc", "sc", "ac", "as", "rc", "rfc", "bk", "if", "sk",
    "fk", "ik", "ud", "cd", "ca", "cp", "se", "sa", "sad", "bc", "fck",
    "vfl", "vfb", "tsv", "bv", "sv", "ssc", "rcd", "ogc", "asm", "kv",
    "vv", "kd", "club", "football", "calcio", "futbol", "de",
)
#: Names that alone mean no single team.
GUARDED = (
    "paris", "united", "city", "olympique", "saint germain", "sporting",
    "athletic", "atletico", "real", "dynamo", "dinamo", "rovers",
    "wanderers", "rangers", "county", "albion", "vale", "town",
    "villa", "forest", "wolves", "eagles", "stars",
)
#: Words that mark women's and youth teams.
WOMEN = ("women", "woman", "ladies", "dames", "feminine", "feminin", "feminines", "femenil", "femenino", "femenina", "frauen", "femminile")
YOUTH = ("youth", "junior", "juniors", "reserves", "reserve", "academy")
#: What a status text says when a game is off.
CANCELLED = ("postpon", "cancel", "abandon", "report", "annul")


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility forms apart, without combining marks, in lower case."""
    return text.map(_fold, na_action="ignore")


@lru_cache(maxsize=1 << 18)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio (X06); a worker remembers a bounded number of pairs."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\p{Punct}\p{Pd}’‘`´\s]+", " "))


def normal_name(text: Column, ascii_only: bool = False) -> Column:
    """Of at most 5000 characters. ascii_only: for names known to have no accents, without Python."""
    cut = F.substring(F.trim(text), 1, 5000)
    return _spaced(F.lower(cut) if ascii_only else folded(cut))


def compact_name(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(folded(text), "[^a-z0-9]", "")


def without_club_tokens(name: Column) -> Column:
    """The name itself if nothing else is left."""
    kept = F.array_join(F.filter(F.split(name, " "), lambda t: ~t.isin(*CLUB_TOKENS)), " ")
    return F.coalesce(F.nullif(kept, F.lit("")), name)


def split_sides(label: Column) -> Column:
    """home, away of "A vs B" or "A v B" (X04, T9): at a whole word only."""
    pattern = r"(?i)^\s*(.+?)\s+(?:vs\.?|v)\s+(.+?)\s*$"
    side = lambda i: F.nullif(F.regexp_extract(label, pattern, i), F.lit(""))
    return F.struct(side(1).alias("home"), side(2).alias("away"))


def category(name: Column) -> Column:
    """women, uNN, youth, or open, by whole words of a normal name."""
    words = F.split(name, " ")
    level = F.regexp_extract(name, r"\bu(1[5-9]|2[0-3])\b", 0)
    has = lambda of: F.arrays_overlap(words, F.array(*map(F.lit, of)))
    return F.when(has(WOMEN), "women").when(level != "", level).when(has(YOUTH), "youth").otherwise("open")


def fallback_key(competition: Column, kickoff: Column, home: Column, away: Column) -> Column:
    """X07, T23."""
    return F.concat_ws("|", competition, F.date_format(kickoff, "yyyyMMddHH"), home, away)


def canonical_match_id(competition: Column, day: Column, home: Column, away: Column) -> Column:
    """X08."""
    return F.concat(F.lit("match:"), F.concat_ws("|", competition, day.cast("string"), home, away))


def short_hash(text: Column) -> Column:
    """X09."""
    return F.substring(F.sha2(text, 256), 1, 16)


def french_form(form: Column) -> Column:
    """X10."""
    return F.translate(form, "WDL", "VND")


def cancelled(status: Column) -> Column:
    """X13."""
    return F.lower(status).rlike("|".join(CANCELLED))


def timeline_icon(text: Column) -> Column:
    """The first rule that applies."""
    t = F.lower(text)
    return F.when(t.contains("goal"), "goal").when(t.contains("red card"), "red").when(t.contains("yellow card"), "yellow").when(t.contains("substitution"), "sub").when(t.contains("penalty"), "penalty").otherwise("other")


def host(url: Column) -> Column:
    """X19."""
    return F.try_parse_url(url, F.lit("HOST"))


def thumbnail(url: Column, cdn: str, width: int = 64) -> Column:
    """Pictures of one content host in a small size (X11)."""
    return F.when(host(url) == cdn, F.concat(F.split(url, r"\?")[0], F.lit(f"?w={width}"))).otherwise(url)


def form_sentence(home: Column, away: Column, home_wins: Column, away_wins: Column) -> Column:
    """What recent wins say of a fixture, in a sentence."""
    better = lambda a, n, b, m: F.format_string("%s comes in better form (%d wins) than %s (%d).", a, n, b, m)
    like = F.format_string("%s (%d wins) and %s (%d) are in like form.", home, home_wins, away, away_wins)
    return F.when(home_wins > away_wins + 1, better(home, home_wins, away, away_wins)).when(away_wins > home_wins + 1, better(away, away_wins, home, home_wins)).otherwise(like)
