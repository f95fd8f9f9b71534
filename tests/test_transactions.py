"""Transactions over several tables: failures between steps, repeated batches, rivals; recovery; versions known at an instant."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foretide.operators import intervals
from foretide.plans import commit_queries
from foretide.sources import sinks, transactions
from foretide.streaming import pipelines

SCHEMA = "k long, v string"


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def _all(spark, root, table):
    return sorted(tuple(r) for r in transactions.read(spark, root, table, SCHEMA).collect())


def _failing(spark):
    @F.udf("string")
    def fail(x):
        raise RuntimeError("lost on the way")

    return _rows(spark, (9, "z")).select("k", fail("v").alias("v"))


def test_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path)
    assert _all(spark, root, "a") == []
    assert transactions.commit(spark, root, "t1", {"a": _rows(spark, (1, "x")), "b": _rows(spark, (1, "y"), (2, "y"))}, 1)
    with pytest.raises(Exception, match="lost on the way"):
        transactions.commit(spark, root, "t2", {"a": _rows(spark, (2, "x")), "b": _failing(spark)}, 2)
    assert _all(spark, root, "a") == [(1, "x")] and _all(spark, root, "b") == [(1, "y"), (2, "y")]
    assert transactions.commit(spark, root, "t2", {"a": _rows(spark, (2, "x")), "b": _rows(spark, (3, "y"))}, 2)
    assert not transactions.commit(spark, root, "t2", {"a": _rows(spark, (7, "never")), "b": _rows(spark)}, 2)
    assert _all(spark, root, "a") == [(1, "x"), (2, "x")] and _all(spark, root, "b") == [(1, "y"), (2, "y"), (3, "y")]
    gone = transactions.forgotten(spark, root)
    assert gone and all("/t2-" in g for g in gone) and len(_all(spark, root, "a")) == 2
    named = transactions.read(spark, root, "b", SCHEMA, with_transaction=True).groupBy("transaction").count().collect()
    assert {(r.transaction, r["count"]) for r in named} == {("t1", 2), ("t2", 1)}
    with pytest.raises(ValueError):
        transactions.commit(spark, root, "../t3", {})


def test_of_two_rivals_one_commits(spark, tmp_path, monkeypatch):
    """The second looks before the first has committed: its rename is refused, and its rows are not read."""
    root = str(tmp_path)
    assert transactions.commit(spark, root, "t", {"a": _rows(spark, (1, "first"))})
    monkeypatch.setattr(transactions, "committed", lambda *_: False)
    assert not transactions.commit(spark, root, "t", {"a": _rows(spark, (1, "second"))})
    assert _all(spark, root, "a") == [(1, "first")]


def test_a_killed_run_and_another(spark, sf, tmp_path):
    """A stream of several batches that breaks off between two tables, and again after a commit, goes on to one result."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: pipelines.source(spark, str(tmp_path / "events.parquet"), events.schema, files_per_batch=1)
    root, calls = str(tmp_path / "root"), []
    whole = transactions.in_transactions(root, "events", commit_queries.made_of_batch)

    def breaks(batch, number):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            made = commit_queries.made_of_batch(batch, number)
            made["totals"] = made["totals"].withColumn("n", F.raise_error(F.lit("killed")).cast("long"))
            transactions.commit(spark, root, f"events-{number}", made, number)
        whole(batch, number)
        if number == 2 and calls.count(2) == 1:
            raise RuntimeError("killed after the commit")

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            pipelines.run_batches(stream(), breaks, str(tmp_path / "state"), "append")
    pipelines.run_batches(stream(), breaks, str(tmp_path / "state"), "append")
    assert calls == [0, 1, 1, 2, 2, 3]
    assert transactions.manifests(spark, root).select("transaction").distinct().count() == 4
    want = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    assert sorted(map(str, commit_queries.committed_tables(spark, root).collect())) == sorted(map(str, want.collect()))


def test_what_to_recover(spark):
    at = lambda m: datetime(2026, 1, 1, 12) + timedelta(minutes=m)
    rows = [("fresh", 1, at(-3), at(-1)), ("fresh", 2, at(-1), None), ("old", 1, at(-99), at(-90)), ("edge", 1, at(-9), at(-1)), ("never", 1, at(-5), None), ("later", 1, at(-5), at(5)), ("unknown", 1, at(1), at(2))]
    cycles = spark.createDataFrame(rows, "name string, cycle long, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = {r.name: (r.last_cycle, r.unfinished, r.idle_seconds) for r in transactions.to_recover(cycles, "2026-01-01 12:00:00", 15).collect()}
    assert got == {"old": (1, 0, 5400), "never": (None, 1, None), "later": (None, 1, None)}


def test_feed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "y")], "g string, at long, v string")
    sinks.feed(rows, ["g"], ["at"], str(tmp_path / "f"))
    assert list((tmp_path / "f").glob("*.gz"))
    back = sinks.read_feed(spark, str(tmp_path / "f"), "g string, rows array<struct<at:long,v:string>>")
    assert {r.g: [tuple(x) for x in r.rows] for r in back.collect()} == {"a": [(1, None), (2, "x")], "b": [(1, "y")]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_known(spark, seed):
    """All pairs of probes and versions, by what is known at each probe's own instant."""
    rng, zero = random.Random(seed), datetime(2026, 1, 1)
    instant = lambda: zero + timedelta(microseconds=rng.choice((rng.randrange(40), rng.randrange(10**6), rng.randrange(10**13))))
    versions = [(rng.choice("ab") if rng.random() < 0.9 else None, i, instant(), rng.choice((None, instant()))) for i in range(120)]
    versions += [("a", 200, versions[0][2], None), ("b", 201, None, None)]
    probes = [(rng.choice("abc"), i, rng.choice((instant(), versions[i % 120][2]))) for i in range(150)] + [("a", 900, None), (None, 901, zero)]
    want = set()
    for k, i, at in probes:
        known = [v for v in versions if k is not None and at is not None and v[0] == k and v[2] is not None and v[2] <= at]
        last = max((v[2] for v in known), default=None)
        want |= {(i, v[1]) for v in known if v[2] == last and (v[3] is None or v[3] <= at)}
    left = spark.createDataFrame(probes, "k string, probe_id long, as_of timestamp_ntz")
    right = spark.createDataFrame(versions, "k string, version_id long, retrieved_at timestamp_ntz, effective_at timestamp_ntz")
    got = [(r.probe_id, r.version_id) for r in intervals.known_at(left, right, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
