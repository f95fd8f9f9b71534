"""The append-only ledger of forecasts: versions, settlement, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions.numbers import brier_binary, log_loss


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def versions(offers: DataFrame, key: str, at: list[str], content: Column) -> DataFrame:
    """The first offer of each content of a key, numbered in their order (L01, L03, W12): a content that comes back after
    another one makes no new version. The first of each content is found before anything is ordered."""
    first = offers.withColumn("hash", content).groupBy(key, "hash").agg(F.min(F.struct(*at)).alias("first"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("first", "hash"))
    out = first.withColumn("version_seq", order).select(key, "hash", *[F.col(f"first.{a}").alias(a) for a in at], "version_seq")
    return out.withColumn("replaces", F.when(F.col("version_seq") > 1, F.col("version_seq") - 1))


def not_late(offers: DataFrame, at: str = "frozen_at", start: str = "kickoff") -> DataFrame:
    """Nothing is published from the start on (T-05)."""
    return offers.filter(F.col(at) < F.col(start))


def reference_version(offers: DataFrame, key: str = "match_id") -> DataFrame:
    """version_seq that counts for a key (J04, J10, L04, L05): the last one frozen 15 minutes before the start or
    earlier, else the last one before the start. One aggregate; keys without any are left out."""
    early = F.col("frozen_at") <= F.col("kickoff") - F.expr("INTERVAL 15 MINUTES")
    valid = F.col("frozen_at") <= F.col("kickoff")
    chosen = F.coalesce(F.max(F.when(early, F.col("version_seq"))), F.max(F.when(valid, F.col("version_seq"))))
    return offers.groupBy(key).agg(chosen.alias("version_seq"), F.max(F.when(early, True)).isNotNull().alias("at_t15")).filter("version_seq IS NOT NULL")


def outcome(family: Column, hg: Column, ag: Column) -> Column:
    """What happened in a family."""
    over = lambda n: F.when(hg + ag >= n, "PLUS").otherwise("MOINS")
    by = F.when(hg > ag, "1").when(hg == ag, "N").otherwise("2")
    double = F.when(hg > ag, "1N").when(hg < ag, "N2").otherwise("NUL")
    both = F.when((hg > 0) & (ag > 0), "OUI").otherwise("NON")
    return F.when(family == "1N2", by).when(family == "DC", double).when(family == "O1.5", over(2)).when(family == "O2.5", over(3)).when(family == "O3.5", over(4)).when(family == "BTTS", both)


def won(family: Column, selection: Column, hg: Column, ag: Column) -> Column:
    """A draw wins both double chances that hold it."""
    needed = F.when(family == "O1.5", 2).when(family == "O2.5", 3).when(family == "O3.5", 4)
    both = (hg > 0) & (ag > 0)
    exclusive = selection == outcome(family, hg, ag)
    leg = F.when(selection == "1N", hg >= ag).when(selection == "N2", hg <= ag).when(selection == "12", hg != ag)
    leg = leg.when(selection == "PLUS", hg + ag >= needed).when(selection == "MOINS", hg + ag < needed).when(selection == "OUI", both).when(selection == "NON", ~both)
    return F.when(family == "1N2", exclusive).otherwise(leg)


def settle(rows: DataFrame) -> DataFrame:
    """outcome, won, brier, logloss of rows (family, selection, p, p1, px, p2, hg, ag): the three-way family over its whole
    distribution, all others as one selection that wins or not (L06, N07, N08)."""
    hg, ag, family, p = F.col("hg"), F.col("ag"), F.col("family"), F.col("p")
    rows = rows.withColumns({"outcome": outcome(family, hg, ag), "won": won(family, F.col("selection"), hg, ag)})
    three = sum((F.pow(F.col(c) - F.when(F.col("outcome") == s, 1.0).otherwise(0.0), F.lit(2)) for s, c in (("1", "p1"), ("N", "px"), ("2", "p2"))), F.lit(0.0))
    real = F.when(F.col("outcome") == "1", F.col("p1")).when(F.col("outcome") == "N", F.col("px")).otherwise(F.col("p2"))
    return rows.withColumns({
        "brier": F.when(family == "1N2", three).otherwise(brier_binary(p, F.col("won"))),
        "logloss": F.when(family == "1N2", log_loss(real)).otherwise(log_loss(F.when(F.col("won"), p).otherwise(1 - p))),
    })


def market_decided(market: Column, hg: Column, ag: Column) -> Column:
    """Whether a running score has already decided a market."""
    line = F.regexp_extract(market, r"([0-9.]+)$", 1).try_cast("double")
    return F.when(market == "both score", (hg > 0) & (ag > 0)).when(market.rlike("^(over|under) "), hg + ag > line).otherwise(F.lit(False))


def status(is_won: Column, void: Column) -> Column:
    """F09."""
    return F.when(is_won.isNotNull(), "SETTLED").when(void, "VOID").otherwise("PREDICTION_FROZEN")


def merge_upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """Later rows win, but never with a null or an empty text (S19). One shuffle by the key."""
    both = stored.withColumn("at", F.lit(0).cast("long")).unionByName(incoming.withColumn("at", F.col(order).cast("long") + 1))
    filled = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("at")))
    return both.groupBy(key).agg(*[filled(c).alias(c) for c in keep])


def insert_once(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What is new among incoming, each key once (S20, J05, J06): the first by `order`."""
    fresh = incoming.join(stored.select(*key), key, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return fresh.withColumn("rank", rank).filter("rank = 1").drop("rank")


def latest(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last n rows of each key with their rank (S21, W02, K06, L15); the limit goes below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def immutability_violations(old: DataFrame, new: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """Keys whose fixed columns changed, with the names of these, and keys that are gone."""
    was, now = old.select(*key, F.struct(*fixed).alias("was")), new.select(*key, F.struct(*fixed).alias("now"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in fixed]))
    both = was.join(now, key, "left").withColumn("violation", F.when(F.col("now").isNull(), "deleted").otherwise(F.array_join(changed, ",")))
    return both.filter("violation <> ''").select(*key, "violation")


def missing_parents(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that refer to nothing."""
    return child.join(parent.select(key), key, "left_anti")


def verified(rows: DataFrame, stored: str, *columns: str) -> DataFrame:
    """Whether a stored hash is still that of the row."""
    return rows.withColumn("verified", F.col(stored) == content_hash(*columns))


def verdicts(settled: DataFrame) -> DataFrame:
    """Per fixture: the real outcome, whether the three-way pick was right, and whether the surest family was."""
    sure = F.max_by("won", F.struct("p", F.col("family")))
    return settled.groupBy("match_id").agg(F.max(F.when(F.col("family") == "1N2", F.col("outcome"))).alias("real"), F.max(F.when(F.col("family") == "1N2", F.col("won"))).alias("pick_ok"), sure.alias("safest_ok"))
