"""The life of a forecast: what is archived with it, what it is settled or voided by, and what is shown of it later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions.text import cancelled
from foretide.operators.ledger import content_hash, reference_version, settle

#: States after which a fixture is never settled again.
FINAL = ("SETTLED", "VOID", "NOT_EVALUABLE")
#: From this reliability on a snapshot is full.
FULL_FROM = 0.6


def snapshots(forecasts: DataFrame, features: list[str], output: list[str], present: dict[str, Column], reliability: Column) -> DataFrame:
    """payload (JSON of what went in and came out, without any instant, so that equal forecasts are equal texts), its hash, the
    available fields, and whether it is full or partial (L02)."""
    fields = F.array_compact(F.array(F.lit("team_stats"), F.lit("league_avgs"), *[F.when(held, F.lit(name)) for name, held in present.items()]))
    payload = F.to_json(F.struct(F.struct(*features).alias("features"), F.struct(*output).alias("output")))
    rows = forecasts.withColumns({"payload": payload, "available": fields})
    return rows.withColumns({"payload_hash": F.sha2("payload", 256), "completeness": F.when(F.coalesce(reliability, F.lit(0.0)) >= FULL_FROM, "full").otherwise("partial")})


def reference_marks(offers: DataFrame, minutes: int = 15) -> DataFrame:
    """The version in force `minutes` before the start, once for each fixture that had one (L04): an entry of the event log."""
    early = offers.filter(F.col("frozen_at") <= F.col("kickoff") - F.make_dt_interval(mins=F.lit(minutes)))
    return early.groupBy("match_id").agg(F.max_by("version_seq", F.struct("frozen_at", "version_seq")).alias("version_seq")).withColumn("kind", F.lit("t15_reference"))


def evaluation_versions(offers: DataFrame, marks: DataFrame) -> DataFrame:
    """The version that counts: the marked one if it was frozen by the start, else the last one frozen by then."""
    valid = offers.filter(F.col("frozen_at") <= F.col("kickoff"))
    marked = valid.join(marks.filter("kind = 't15_reference'").select("match_id", F.col("version_seq").alias("marked")), "match_id", "left")
    best = marked.groupBy("match_id").agg(F.max(F.when(F.col("version_seq") == F.col("marked"), F.col("marked"))).alias("by_mark"), F.max("version_seq").alias("last"))
    return best.select("match_id", F.coalesce("by_mark", "last").alias("version_seq"), F.col("by_mark").isNotNull().alias("by_mark"))


def evaluation_feed(offers: DataFrame, marks: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the versions that count."""
    return rows.join(evaluation_versions(offers, marks).select("match_id", "version_seq"), ["match_id", "version_seq"])


def endings(matches: DataFrame, versions: DataFrame) -> DataFrame:
    """evaluation_status and whether it is new (L06): nothing before the end or without an official score, VOID by the words of
    a cancellation, NOT_EVALUABLE without a version that counts; what is final stays as it is.

    Columns match_id, state, completed, hg, ag, detail, evaluation_status; versions: match_id of fixtures with a version that counts.
    """
    off = F.coalesce(cancelled(F.col("detail")), F.lit(False))
    done = F.col("completed") & F.col("hg").isNotNull() & F.col("ag").isNotNull() & ~off
    before = F.coalesce(F.col("evaluation_status").isin(*FINAL), F.lit(False))
    known = versions.select("match_id", F.lit(True).alias("counted")).distinct()
    now = F.when(F.col("state") != "post", F.col("evaluation_status")).when(before, F.col("evaluation_status")).when(off, "VOID")
    now = now.when(~F.coalesce(done, F.lit(False)), F.col("evaluation_status")).when(F.col("counted"), "SETTLED").otherwise("NOT_EVALUABLE")
    rows = matches.join(known, "match_id", "left").withColumn("status", now)
    return rows.withColumn("is_new", ~before & F.coalesce(F.col("status").isin(*FINAL), F.lit(False))).drop("counted", "evaluation_status").withColumnRenamed("status", "evaluation_status")


def results(ended: DataFrame) -> DataFrame:
    """The official result of what is settled or can't be (an entry of the results table, once)."""
    return ended.filter("is_new AND evaluation_status IN ('SETTLED', 'NOT_EVALUABLE')").select("match_id", "hg", "ag")


def settled_rows(ended: DataFrame, counted: DataFrame) -> DataFrame:
    """Outcome, Brier score and log loss (6 places) of the rows that count, of fixtures that are settled now."""
    now = ended.filter("is_new AND evaluation_status = 'SETTLED'").select("match_id", "hg", "ag")
    rows = settle(counted.join(now, "match_id")).filter("outcome IS NOT NULL")
    return rows.withColumns({c: F.round(c, 6) for c in ("brier", "logloss")})


def statuses(rows: DataFrame, ended: DataFrame, settled: DataFrame) -> DataFrame:
    """The status of each row of a forecast: settled rows, the frozen ones of a void fixture's latest version (L07, T18: of no other),
    and all others as they were. Columns match_id, version_seq, family, status."""
    last = F.max("version_seq").over(Window.partitionBy("match_id"))
    over = ended.select("match_id", "evaluation_status")
    scored = settled.select("match_id", "version_seq", "family", F.lit(True).alias("scored"))
    out = rows.withColumn("last", last).join(over, "match_id", "left").join(scored, ["match_id", "version_seq", "family"], "left")
    void = (F.col("evaluation_status") == "VOID") & (F.col("version_seq") == F.col("last")) & (F.col("status") == "PREDICTION_FROZEN")
    return out.withColumn("status", F.when(F.col("scored"), "SETTLED").when(void, "VOID").otherwise(F.col("status"))).drop("last", "evaluation_status", "scored")


def display(snapshots_of: DataFrame, versions: DataFrame, output: str, model: str) -> DataFrame:
    """What was forecast before the start, read again from the archived text, never computed anew (L09, Z07). output: its DDL."""
    rows = snapshots_of.join(versions, ["match_id", "version_seq"])
    read = F.from_json(F.col("payload"), f"STRUCT<output:STRUCT<{output}>>")["output"]
    return rows.select("match_id", read.alias("output"), F.lit(True).alias("frozen"), "version_seq", "frozen_at", F.lit(model).alias("model"), F.lit(False).alias("calibrated"))


def verdict_rows(settled: DataFrame) -> DataFrame:
    """Per fixture: real outcome, score, the three-way pick and whether it was right, and the surest row with its label,
    chance in percent and result (L08). Of rows as sure as each other the one whose family comes first."""
    three = lambda c: F.max(F.when(F.col("family") == "1N2", F.col(c)))
    sure = F.min_by(F.struct("family", "selection", "p", "won"), F.struct((-F.col("p")).alias("p"), F.col("family")))
    out = settled.groupBy("match_id").agg(three("outcome").alias("real"), F.first(F.concat_ws("-", F.col("hg").cast("string"), F.col("ag").cast("string"))).alias("score"), three("selection").alias("pick"), sure.alias("sure"))
    label = F.concat_ws(" · ", "sure.family", "sure.selection")
    return out.select("match_id", "real", "score", "pick", (F.col("pick") == F.col("real")).alias("pick_ok"), label.alias("safe_label"), F.round(F.col("sure.p") * 100, 1).alias("safe_p"), F.col("sure.won").alias("safe_ok"))


def registered_models(registrations: DataFrame) -> DataFrame:
    """Each name and version once, as it was registered first, with the hash of its settings."""
    first = F.min_by(F.struct("configuration", F.col("registered_at").alias("active_from"), "retired_at"), "registered_at")
    out = registrations.groupBy("name", "version").agg(first.alias("m")).select("name", "version", "m.*")
    return out.withColumn("configuration_hash", F.substring(F.sha2("configuration", 256), 1, 16))


def active_models(models: DataFrame) -> DataFrame:
    """Of each name the version that became active last among those that are not retired."""
    held = models.filter("retired_at IS NULL")
    rest = [c for c in models.columns if c != "name"]
    return held.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("active_from", "version")).alias("m")).select("name", "m.*")


def versions_in_order(rows: DataFrame) -> DataFrame:
    """The full history of each fixture's rows in the order of their versions, with the content's hash."""
    order = F.row_number().over(Window.partitionBy("match_id").orderBy("version_seq", "family"))
    return rows.withColumns({"place": order, "hash": content_hash("match_id", "version_seq", "family", "selection")})


def counts_by_reference(offers: DataFrame) -> DataFrame:
    """How many fixtures count by a mark, by their last version in time, or not at all."""
    held = reference_version(offers)
    every = offers.select("match_id").distinct().join(held, "match_id", "left")
    kind = F.when(F.col("version_seq").isNull(), "none").when(F.col("at_t15"), "mark").otherwise("last")
    return every.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
