"""State by key that expires, and timers without data, on folders of files that grow while a stream runs."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from foretide.streaming import pipelines
from foretide.streaming.stateful import first_of_content, pushes, state_by_key

SCHEMA = "k long, at long, content string"


def _add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))



def test_state_expires(spark, tmp_path):
    """Within its time a content is known over restarts; forgotten, it is new, and the number goes on."""
    _add(spark, tmp_path / "in", [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a"), (2, 2, None), (2, 3, None)])

    def run(remember, out):
        with state_by_key(spark):
            rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            pipelines.run_available(first_of_content(rows, "k", "content", ["at"], remember), str(tmp_path / out), str(tmp_path / f"state-{out}"))
        return sorted(map(str, _read_rows(spark, tmp_path / out)))

    first = [(1, 1, "a", 1), (1, 2, "b", 2), (2, 1, "a", 1), (2, 2, None, 2)]
    assert run(3_600_000, "long") == run(1_000, "short") == sorted(map(str, first))
    _add(spark, tmp_path / "in", [(1, 4, "b"), (1, 5, "c")])
    assert run(3_600_000, "long") == sorted(map(str, [*first, (1, 5, "c", 3)]))
    time.sleep(2)
    _add(spark, tmp_path / "in", [(1, 6, "a"), (2, 4, "a")])
    assert run(3_600_000, "long") == sorted(map(str, [*first, (1, 5, "c", 3)]))
    assert run(1_000, "short") == sorted(map(str, [*first, (1, 4, "b", 3), (1, 5, "c", 4), (1, 6, "a", 5), (2, 4, "a", 3)]))


def _read_rows(spark, folder, more="version long"):
    return [tuple(r) for r in spark.read.schema(f"{SCHEMA}, {more}").parquet(str(folder)).collect()]


def test_signs_of_life(spark, tmp_path):
    """A key that falls quiet gives each sign of life once, a key that goes on gives none before its time; a repeated content is no push."""
    _add(spark, tmp_path / "in", [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a")])
    with state_by_key(spark, idle_batches=True):
        rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = pushes(rows, "k", "content", ["at"], quiet=3_000, most=2)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        found, until = [], time.time() + 60
        while time.time() < until and sum(r[3] == "heartbeat" for r in found) < 4:
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists():
                found = _read_rows(spark, tmp_path / "out", "kind string, beat long")
        time.sleep(4)
        _add(spark, tmp_path / "in", [(2, 2, "a"), (2, 3, "c")])
        while time.time() < until and not any(r[2] == "c" for r in found):
            time.sleep(0.5)
            found = _read_rows(spark, tmp_path / "out", "kind string, beat long")
    finally:
        query.stop()
    changes = sorted(r[:3] for r in found if r[3] == "change")
    beats = sorted((r[0], r[2], r[4]) for r in found if r[3] == "heartbeat" and r[2] != "c")
    assert changes == [(1, 1, "a"), (1, 3, "b"), (2, 1, "a"), (2, 3, "c")]
    assert beats == [(1, "b", 1), (1, "b", 2), (2, "a", 1), (2, "a", 2)]


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with state_by_key(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before and spark.range(3).agg(F.sum("id")).first()[0] == 3
