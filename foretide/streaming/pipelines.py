"""Structured Streaming: ingestion steps over an unbounded table of events. Each takes a streaming DataFrame and gives one; run_available()
drives a query over what is there, and a checkpoint makes it go on where it ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foretide.streaming.stateful import DAY_MS, first_of_content, pushes


def source(spark: SparkSession, table: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The files of a table as a stream (T-01), be it a folder of files or one file. All files that are there make one batch
    unless files_per_batch says otherwise: files that come out of the order of their times then can't make each other late."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    if found.isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())  # a stream reads folders


def timed(events: DataFrame) -> DataFrame:
    """Event times as instants, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and type, with late data dropped after `late`."""
    out = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def exactly_once(events: DataFrame, key: list[str], late: str = "2 days") -> DataFrame:
    """Each key once (T-07, T-09); state goes with the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def on_time(events: DataFrame, start: str = "kickoff") -> DataFrame:
    """T-05: nothing from the start on."""
    return events.filter(F.col("ts") < F.col(start))


def changes(events: DataFrame, remember: int = 90 * DAY_MS) -> DataFrame:
    """Events that change a key's content to one it has not had, with their version (T-02, T-04, T-08): see first_of_content()."""
    rows = timed(events).withColumn("fingerprint", F.concat_ws("|", "event_type", F.floor(F.col("value") / 50).cast("string")))
    return first_of_content(rows, "user_id", "fingerprint", ["ts", "event_id"], remember).select("user_id", "event_id", "ts", "fingerprint", "version")


def pushed(events: DataFrame, quiet: int = 100_000, most: int = 1 << 30) -> DataFrame:
    """Events whose content is not that of the one before of their key, and signs of life of quiet keys (T-03): see pushes()."""
    rows = timed(events).withColumn("content", F.concat_ws("|", "event_type", F.floor(F.col("value") / 50).cast("string")))
    return pushes(rows, "user_id", "content", ["ts", "event_id"], quiet, most)


_MARKS = "match_id long, version long, marked_at timestamp"


def reference_marks(offers: DataFrame, minutes: int = 15, late: str = "1 day") -> DataFrame:
    """The version in force `minutes` before each key's start, told once, by a timer on event time (T-06). Columns match_id, ts, kickoff, version.

    State of a key: the last offer frozen by then. Offers may come in any order within `late`; when the watermark has passed the timer
    the mark is told, and the state goes a day after the start, when nothing can come any more.
    """

    def micros(times: pd.Series) -> np.ndarray:
        return times.to_numpy().astype("datetime64[us]").astype(np.int64)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, version, timer, told = state.get
            if told:
                state.remove()
                return
            state.update((at, version, timer, True))
            state.setTimeoutTimestamp(max(timer + minutes * 60_000, state.getCurrentWatermarkMs()) + 86_400_000)
            if version >= 0:
                yield pd.DataFrame({"match_id": [key[0]], "version": [version], "marked_at": [pd.Timestamp(timer, unit="ms")]})
            return
        at, version, timer, told = state.get if state.exists else (-1, -1, -1, False)
        for rows in frames:  # a group is a few rows: arrays, for frames would take most of the time
            ts, start = micros(rows["ts"]), micros(rows["kickoff"])
            timer = int(start.max()) // 1000 - minutes * 60_000
            early = np.flatnonzero((ts <= start - minutes * 60_000_000) & rows["ts"].notna().to_numpy())
            if len(early):
                versions = rows["version"].to_numpy()[early]
                last = np.lexsort((versions, ts[early]))[-1]
                at, version = max((at, version), (int(ts[early[last]]), int(versions[last])))
        state.update((at, version, timer, told))
        state.setTimeoutTimestamp(max(timer, state.getCurrentWatermarkMs() + 1) if not told else max(timer, state.getCurrentWatermarkMs()) + 86_400_000)

    rows = timed(offers).withColumn("kickoff", F.col("kickoff").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("match_id").applyInPandasWithState(run, _MARKS, "at long, version long, timer long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def joined_within(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Pairs of two streams with the same key, the right one at most `within` after the left; watermarks bound what is kept."""
    a = timed(left).withWatermark("ts", late).select(F.col(key).alias("key"), F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))
    b = timed(right).withWatermark("ts", late).select(F.col(key).alias("right_key"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    return a.join(b, F.expr(f"key = right_key AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {within}")).select("key", "left_id", "right_id", "left_ts", "right_ts")


def with_details(fixtures: DataFrame, details: DataFrame, within: str = "6 hours", late: str = "1 day") -> DataFrame:
    """match_id, kickoff, detail_at, detail_id: each fixture with all details of its key that come from its start on until `within` later,
    or one row without, told when the watermark says that none can come any more (T-16, T-18). Details and fixtures may come in any
    order within `late`. Columns key, match_id, ts; key, detail_id, ts. current_details() tells what holds of a match."""
    a = timed(fixtures).withWatermark("ts", late).select("key", "match_id", F.col("ts").alias("kickoff"))
    b = timed(details).withWatermark("ts", late).select(F.col("key").alias("of"), "detail_id", F.col("ts").alias("detail_at"))
    met = a.join(b, F.expr(f"key = of AND detail_at >= kickoff AND detail_at <= kickoff + INTERVAL {within}"), "leftOuter")
    return met.select("match_id", "kickoff", "detail_at", "detail_id")


def current_details(told: DataFrame) -> DataFrame:
    """Of each match the last detail told (T-18): a later one corrects those before it, in whatever order they were told, and the
    number of what it replaces is its version; a match of version 0 has none."""
    last = F.max(F.when(F.col("detail_id").isNotNull(), F.struct("detail_at", "detail_id"))).alias("last")
    return told.groupBy("match_id").agg(last, F.count_distinct("detail_id").alias("version")).select("match_id", F.col("last.detail_id").alias("detail_id"), "version")


def run_available(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, as a table (T-14): each batch is one commit, and its id makes a repeated one harmless."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Batches to a function, which must give the same for a batch id that comes again (T-03, S18, S23)."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
