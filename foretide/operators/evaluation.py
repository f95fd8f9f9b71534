"""Reports over settled forecasts: scoreboards, return, drawdown, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.config import EVALUATION


def _accuracy() -> Column:
    return F.round(100 * F.avg(F.col("won").cast("double")), 1)


def scoreboard(settled: DataFrame, *by: str) -> DataFrame:
    """n, accuracy in percent, mean Brier score and log loss."""
    return settled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _accuracy().alias("accuracy"), F.round(F.avg("brier"), 4).alias("brier"), F.round(F.avg("logloss"), 4).alias("logloss"))


def headline(settled: DataFrame) -> DataFrame:
    """One row over everything (A13), without figures below the least sample."""
    three = settled.filter("family = '1N2'")
    row = three.agg(F.countDistinct("match_id").alias("matches"), F.countDistinct("match_id", "version_seq").alias("versions"), _accuracy().alias("accuracy"), F.round(F.avg("brier"), 4).alias("brier"), F.round(F.avg("logloss"), 4).alias("logloss"))
    enough = F.col("matches") >= EVALUATION.least_sample
    return row.select("matches", "versions", F.when(enough, "ok").otherwise("rebuilding").alias("status"), *[F.when(enough, F.col(c)).alias(c) for c in ("accuracy", "brier", "logloss")])


def safest_accuracy(settled: DataFrame) -> DataFrame:
    """How often the surest family of a fixture was right."""
    best = settled.groupBy("match_id").agg(F.max_by("won", F.struct("p", "family")).alias("won"))
    return best.agg(F.count(F.lit(1)).alias("n"), _accuracy().alias("accuracy"))


def profit(settled: DataFrame) -> DataFrame:
    """pnl of one unit on each priced three-way pick (columns odds, won)."""
    return settled.filter("family = '1N2' AND odds IS NOT NULL").withColumn("pnl", F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0))


def roi(priced: DataFrame) -> DataFrame:
    """No yield below the least number of rows."""
    row = priced.agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))
    return row.select("n", F.round("pnl", 4).alias("pnl"), F.when(F.col("n") >= EVALUATION.roi_least, F.round(100 * F.col("pnl") / F.col("n"), 2)).alias("yield_pct"))


def drawdown(priced: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The deepest fall of the running sum from its peak so far, which starts at 0.

    The first of order is an instant. Each month of a series is summed up on its own, in parallel: its sum, its highest and lowest
    point and its own deepest fall; these few rows are then put together in their order.
    """
    rows = priced.withColumn("month", F.date_trunc("month", order[0]))
    so_far = Window.partitionBy(*by, "month").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("equity", F.sum("pnl").over(so_far)).withColumn("fall", F.max("equity").over(so_far) - F.col("equity"))
    months = run.groupBy(*by, "month").agg(F.sum("pnl").alias("total"), F.max("equity").alias("high"), F.min("equity").alias("low"), F.max("fall").alias("fall"))
    earlier = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("base") + F.col("high")).over(earlier), F.lit(0.0)))
    deepest = F.greatest("fall", peak - (F.col("base") + F.col("low")))
    return months.withColumn("deepest", deepest).groupBy(*by).agg(F.round(F.max("deepest"), 4).alias("max_drawdown"))


def calibration(rows: DataFrame, p: str, happened: Column, bins: int = EVALUATION.bins) -> DataFrame:
    """n, mean p and share of wins of each bin."""
    at = F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(0.9999)) * bins).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean_p"), F.round(F.avg(happened.cast("double")), 4).alias("rate"))
