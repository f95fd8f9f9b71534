"""Landing files as a source of Spark, details of fixtures over several batches, picks of a feed against all pairs, and small parsers."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foretide.functions import time
from foretide.operators import identity
from foretide.plans import detail_queries, feed_queries
from foretide.sources import landing, parsers
from foretide.streaming import pipelines
from tests.test_parsers import _every

POINT = "source string, key string, data_type string, value string, retrieved_at string"


def test_landing_files(spark, tmp_path):
    path = str(tmp_path / "land")
    rows = [(s, str(i), t, f"{t} {i}" if i % 5 else None, "2026-01-01") for s in ("feed", "registry", "other") for i in range(50) for t in ("odds", "score")]
    landing.land(spark.createDataFrame(rows, POINT).repartition(3), path)
    (tmp_path / "land" / "source=feed" / "broken.jsonl").write_text('{"key": "x"}\n\n{broken\n[1]\n{"key": "y", "value": {"a": 1}, "more": 2}')
    (tmp_path / "land" / "_SUCCESS_not_read").write_text("{}")
    (tmp_path / "land" / "loose.jsonl").write_text('{"key": "of no source"}')
    got = landing.landed(spark, path)
    more = [("feed", "x", None, None, None), ("feed", "y", None, '{"a": 1}', None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [*rows, *more]))
    assert got.rdd.getNumPartitions() == 1 and spark.read.format("landing").option("path", path).option("bytes", "1").load().rdd.getNumPartitions() > 5
    one = landing.landed(spark, path).filter("source = 'registry' AND data_type IN ('odds', 'none') AND key > '2'").select("value")
    assert sorted(map(str, one.collect())) == sorted(str(r) for r in spark.createDataFrame([r for r in rows if r[0] == "registry" and r[2] == "odds" and r[1] > "2"], POINT).select("value").collect())
    assert landing.landed(spark, path).filter("source = 'nobody'").count() == 0


def test_filters_choose_files(tmp_path):
    """Files of other sources are in no partition."""
    for s in ("a", "b"):
        (tmp_path / f"source={s}").mkdir()
        (tmp_path / f"source={s}" / "f.jsonl").write_text(json.dumps({"key": s}))
    reader = landing.LandingReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([landing.EqualTo(("source",), "a"), landing.EqualTo(("key",), "a"), landing.In(("data_type",), ("x", "y"))]))
    assert [f.attribute for f in left] == [("key",)] and reader.types == {"x", "y"}
    assert [[s for s, _ in p.held] for p in reader.partitions()] == [["a"]]


def test_details_in_any_order(spark, tmp_path):
    """Files out of order, a file a batch: what holds in the end is what a join of all rows gives; rows without a detail are told once, when
    none can come, and later details correct earlier ones."""
    rng, zero = random.Random(4), datetime(2026, 1, 1)
    fixtures = [(i, zero + timedelta(minutes=rng.randrange(6000))) for i in range(60)]
    details = [(rng.randrange(60), i, zero + timedelta(minutes=rng.randrange(6000))) for i in range(500)]
    rows = [("f", k, k, at) for k, at in fixtures] + [("d", k, i, at) for k, i, at in details]
    rows.sort(key=lambda r: (r[3] + timedelta(minutes=rng.randrange(600))))  # at most ten hours late
    rows.append(("f", 999, 999, zero + timedelta(days=30)))
    rows.append(("d", 999, 999, zero + timedelta(days=30)))
    for n in range(0, len(rows), 100):
        spark.createDataFrame(rows[n : n + 100], "kind string, key long, id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = pipelines.with_details(stream.filter("kind = 'f'").withColumnRenamed("id", "match_id"), stream.filter("kind = 'd'").withColumnRenamed("id", "detail_id"), "6 hours", "2 days")
    pipelines.run_available(told, str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r.match_id: (r.detail_id, r.version) for r in pipelines.current_details(out).collect()}
    want = {}
    for k, at in fixtures:
        mine = sorted((t, i) for kk, i, t in details if kk == k and at <= t <= at + timedelta(hours=6))
        want[k] = (mine[-1][1] if mine else None, len(mine))
    assert {k: v for k, v in got.items() if k != 999} == want and any(v[1] == 0 for v in want.values()) and any(v[1] > 1 for v in want.values())
    assert out.filter("detail_id IS NULL").groupBy("match_id").count().filter("count > 1").isEmpty()


def test_picks_of_a_feed(spark, sf):
    """The registered query against the best of all pairs within a day."""
    book = identity.alias_book(spark.createDataFrame([("Team Alpha 1", "t1", 0), ("Alpha One", "t1", 1), ("Team Bravo 2", "t2", 2)], "alias string, canonical_id string, position int"))
    rows = identity.with_canonical(feed_queries.team_events(spark, sf), book)
    best = {}
    for r in _every(rows.filter("source = 's0'"), rows.filter("source = 's1'")).filter("status <> 'NO_MATCH' AND confidence >= 0.70").select("a_event_id", "b_event_id", "confidence", "status").collect():
        best.setdefault(r.a_event_id, []).append((-r.confidence, r.b_event_id, r.status))
    want = {}
    for a, found in best.items():
        found.sort()
        close = len(found) > 1 and -found[0][0] + found[1][0] < 0.05
        sure = not close and found[0][2] in ("MATCH_AUTO", "MATCH_JOURNALIZED")
        want[a] = found[0][1] if sure else -1
    got = {r.a_event_id: r for r in detail_queries.feed_picks(spark, sf).collect()}
    assert len(got) == rows.filter("source = 's0'").count()
    picked = {a: b for a, b in want.items() if b != -1}
    assert {a: r.picked for a, r in got.items() if r.picked != -1} == picked and picked
    assert {r.status for r in got.values()} >= {"MATCH_JOURNALIZED", "UNKNOWN"}


@pytest.mark.parametrize(("text", "want"), [("2026-01-02T03:04Z", 1767323040), ("2026-01-02T03:04:05.999z", 1767323045), ("2026-01-02T03:04:05+09:00", 1767323045), (" 2026-01-02T03:04 ", 1767323040), ("2026-01-02", None), ("soon", None), ("", None), (None, None), ("2026-13-02T03:04", None)])
def test_tolerant_seconds(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(time.tolerant_seconds(F.col("t")).alias("s")).first().s == want


def test_claims_lineups_and_keys(spark):
    claims = {"claims": {"P1": [{"mainsnak": {}}, {"mainsnak": {"datavalue": {"value": {"amount": "+5", "unit": "x"}}}}], "P2": [{"mainsnak": {"datavalue": {"value": "text"}}}], "P3": []}}
    rows = spark.createDataFrame([(1, json.dumps(claims)), (2, "{broken"), (3, None)], "k long, body string")
    assert [tuple(r) for r in parsers.first_claims(rows, ["P1", "P2", "P3", "P9"]).orderBy("k").collect()] == [(1, "+5", "text", None, None), (2, None, None, None, None), (3, None, None, None, None)]
    players = [{"starter": i % 2 == 0, "athlete": {"displayName": f"p{i}"}} for i in range(30)]
    body = json.dumps({"rosters": [{"team": {"id": "7"}, "roster": players}, {"team": {"id": "8"}, "roster": [{"athlete": {"displayName": "q"}}]}]})
    got = {r.team_id: r for r in parsers.lineups(spark.createDataFrame([(1, body), (2, "x")], "k long, body string")).collect()}
    assert got["7"].starters == [f"p{i}" for i in range(0, 22, 2)] and got["7"].substitutes == [f"p{i}" for i in range(1, 25, 2)] and (got["8"].starters, got["8"].substitutes) == ([], ["q"])
    keys = parsers.properties(spark.createDataFrame([(1, '{"a": 1.5, "b": {"c": 2}, "d": null}'), (2, "{no"), (3, None), (4, "{}")], "k long, body string"))
    assert sorted((r.k, r.readable, r.key or "", r.value or "", r.number) for r in keys.collect()) == [(1, True, "a", "1.5", 1.5), (1, True, "b", '{"c":2}', None), (1, True, "d", "", None), (2, False, "", "", None), (3, False, "", "", None)]
