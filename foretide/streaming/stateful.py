"""State of streams by key: a map whose entries expire by themselves, and timers that speak when nothing comes.

State is held in RocksDB, so a key's map never has to fit into memory, and entries are read one by one. Expiry and timers
follow the clock of the machines, not event time: they bound what is kept, they never decide what is late.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXT, _NUMBER = StructType([StructField("text", StringType())]), StructType([StructField("number", LongType())])
DAY_MS = 86_400_000


@contextmanager
def state_by_key(spark: SparkSession, idle_batches: bool = False) -> Iterator[None]:
    """Streams that start within keep their state by key in RocksDB. idle_batches: batches without rows run for the sake of timers;
    without them a stream over what is there ends."""
    names = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class FirstOfContent(StatefulProcessor):
    """Rows whose content a key has not had within `remember` milliseconds, with the key's next version (T-02, T-04, T-08).

    State of a key: a map from content to version, each entry with its own time to live, and the last version, which lives `number`
    milliseconds after its last change. A content that comes again is not refreshed; after it is forgotten it is a new one. Within
    a batch rows are taken in the order given. A null content is one of its own.
    """

    def __init__(self, key: str, content: str, order: list[str], keep: list[str], remember: int, number: int) -> None:
        self.key, self.content, self.order, self.keep, self.remember, self.number = key, content, order, keep, remember, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", _TEXT, _NUMBER, self.remember)
        self.last = handle.getValueState("last", _NUMBER, self.number)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _in_order(rows, self.order).drop_duplicates(self.content)
        texts = ["-" if x is None else f"+{x}" for x in batch[self.content].tolist()]
        fresh = [not self.seen.containsKey((x,)) for x in texts]
        version = self.last.get()[0] if self.last.exists() else 0
        out = batch.loc[fresh].assign(**{self.key: key[0], "version": range(version + 1, version + sum(fresh) + 1)})
        for text, number in zip([x for x, new in zip(texts, fresh, strict=True) if new], out["version"].tolist(), strict=True):
            self.seen.updateValue((text,), (number,))
        if len(out):
            self.last.update((version + len(out),))
        yield out[[self.key, *self.keep, self.content, "version"]]

    def close(self) -> None:
        pass


def first_of_content(rows: DataFrame, key: str, content: str, order: list[str], remember: int = 90 * DAY_MS, number: int = 3650 * DAY_MS) -> DataFrame:
    """key, order, content, version of the rows that FirstOfContent gives, for a stream that is started within state_by_key()."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order, content)) + ", version long"
    processor = FirstOfContent(key, content, order, order, remember, number)
    return rows.select(key, *order, content).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


class PushOfChanges(StatefulProcessor):
    """Rows whose content differs from the one before of their key, and a sign of life of keys from which nothing was pushed (T-03).

    State of a key: what was pushed last, the timer that waits, and the number of signs of life since. A push starts the timer anew; when
    it runs out after `quiet` milliseconds a sign of life goes out and it starts again, `most` times at most.
    """

    def __init__(self, key: str, content: str, order: list[str], quiet: int, most: int) -> None:
        self.key, self.content, self.order, self.quiet, self.most = key, content, order, quiet, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pushed = handle.getValueState("pushed", _TEXT)
        self.beats = handle.getValueState("beats", _NUMBER)
        self.waits = handle.getValueState("waits", _NUMBER)

    def _wait(self, timers) -> None:
        if self.waits.exists():
            self.handle.deleteTimer(self.waits.get()[0])
        at = timers.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(at)
        self.waits.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _in_order(rows, self.order)
        texts = batch[self.content].map(lambda x: "-" if x is None else f"+{x}")
        before = texts.shift(1)
        before.iloc[0] = self.pushed.get()[0] if self.pushed.exists() else None
        out = batch[(texts != before).to_numpy()]
        if len(out):
            self.pushed.update((texts.iloc[-1],))
            self.beats.update((0,))
            self._wait(timerValues)
        yield out.assign(**{self.key: key[0], "kind": "change", "beat": 0})[[self.key, *self.order, self.content, "kind", "beat"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beat, told = self.beats.get()[0] + 1, self.pushed.get()[0]
        self.waits.clear()
        self.beats.update((beat,))
        if beat < self.most:
            self._wait(timerValues)
        row = {self.key: [key[0]], **{c: [None] for c in self.order}, self.content: [None if told == "-" else told[1:]], "kind": ["heartbeat"], "beat": [beat]}
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def pushes(rows: DataFrame, key: str, content: str, order: list[str], quiet: int = 100_000, most: int = 1 << 30) -> DataFrame:
    """key, order, content (a text), kind (change or heartbeat), beat, for a stream that is started within state_by_key()."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order)) + f", `{content}` string, kind string, beat long"
    return rows.select(key, *order, content).groupBy(key).transformWithStateInPandas(PushOfChanges(key, content, order, quiet, most), schema, "Append", "ProcessingTime")
