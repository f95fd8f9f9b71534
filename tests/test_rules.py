"""Rules that need more than a table of the given data: ties, dates, candidates, and a timer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from foretide.functions import numbers, time
from foretide.operators import identity, lifecycle, reports
from foretide.streaming import pipelines


TIES = (0.125, 0.375, 2.675, -0.125, 1.005, 1.115, -2.675, 0.0, 3.0, 0.045, 1e6 + 0.005, 0.285)


def test_half_goes_to_even(spark):
    """As the binary value says: 2.675 lies below its half, 0.125 and 0.375 on it."""
    rows = spark.createDataFrame([(x,) for x in TIES], "x double")
    assert [r.y for r in rows.select(numbers.round_half_even(F.col("x"), 2).alias("y")).collect()] == [round(x, 2) for x in TIES]


def test_days_of_two_digits(spark):
    rows = spark.createDataFrame([("15/08/1995",), ("15/08/95",), ("15/08/68",), (" 1/2/69 ",), ("31/02/2020",), ("x",), (None,)], "t string")
    assert [str(r.d) for r in rows.select(time.parse_day(F.col("t")).alias("d")).collect()] == ["1995-08-15", "1995-08-15", "2068-08-15", "1969-02-01", "None", "None", "None"]


def _events(spark, rows):
    book = identity.alias_book(spark.createDataFrame([("Nova", "n1", 0)], "alias string, canonical_id string, position int"))
    schema = "event_id long, source string, external_id string, home string, away string, competition string, kickoff timestamp_ntz, venue string"
    return identity.with_canonical(spark.createDataFrame([(i, s, None, h, a, "l", datetime(2024, 1, d, 15), None) for i, s, h, a, d in rows], schema), book)


def test_events_are_picked_or_not(spark):
    probes = _events(spark, [(1, "p", "Red Town", "Blue City", 5), (2, "p", "Green Park", "Grey Hill", 5), (3, "p", "Nova", "Pink Lake", 5), (4, "p", "Twin A", "Twin B", 5)])
    feed = _events(spark, [(11, "f", "Red Town FC", "Blue City", 5), (12, "f", "Green Park", "Other Side", 9), (13, "f", "Nova", "Pink Lake", 5), (14, "f", "Twin A", "Twin B", 5), (15, "f", "Twin A", "Twin B", 5)])
    got = {r.a_event_id: (r.picked, r.status) for r in identity.pick_events(probes, feed).collect()}
    assert got[1] == (11, "MATCH_JOURNALIZED") and got[3][0] == 13
    assert got[2] == (None, "NO_MATCH") and got[4] == (None, "UNKNOWN")


def test_later_knowledge_is_no_candidate(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (2, datetime(2024, 1, 3), None), (3, datetime(2024, 1, 1), datetime(2024, 1, 4))], "event_id long, retrieved_at timestamp_ntz, effective_at timestamp_ntz")
    assert [r.event_id for r in identity.known_by(rows, "2024-01-02 00:00:00").collect()] == [1]
    keys = spark.createDataFrame([("a b", None), ("c", "x")], "name string, id string").select(identity.identity_key(F.col("name"), F.col("id")).alias("k"))
    assert [r.k for r in keys.collect()] == ["name:a b", "x"]


def test_final_fixtures_stay(spark):
    schema = "match_id long, state string, completed boolean, hg long, ag long, detail string, evaluation_status string"
    rows = [(1, "post", True, 2, 1, "FT", None), (2, "post", True, 2, 1, "FT", "VOID"), (3, "post", False, None, None, "Abandoned", None), (4, "pre", False, None, None, None, None), (5, "post", True, None, 1, "FT", None), (6, "post", True, 0, 0, None, None)]
    versions = spark.createDataFrame([(1,), (2,), (3,)], "match_id long")
    got = {r.match_id: (r.evaluation_status, r.is_new) for r in lifecycle.endings(spark.createDataFrame(rows, schema), versions).collect()}
    assert got == {1: ("SETTLED", True), 2: ("VOID", False), 3: ("VOID", True), 4: (None, False), 5: (None, False), 6: ("NOT_EVALUABLE", True)}


def test_health_of_nothing(spark):
    rows = spark.createDataFrame([(1, "DONE", None, 1, 1)], "cycle_id long, status string, finished_at timestamp_ntz, matches long, requests long")
    assert reports.data_health(rows).first().health == reports.data_health(rows.limit(0)).first().health == "unknown"


def test_timer_fires_once(spark, tmp_path):
    """Over batches that come out of order, and a second start of the stream."""
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    files = [[(1, at(8), at(12), 1), (1, at(11, 50), at(12), 3), (2, at(9), at(20), 7)], [(1, at(10), at(12), 2), (3, at(1), at(23, 59), 9)], [(2, at(10), at(20), 8), (4, at(23, 58), at(23, 59), 5)], [(4, datetime(2024, 1, 9), datetime(2024, 1, 10), 6)]]
    schema = "match_id long, ts timestamp, kickoff timestamp, version long"
    out = []
    for number in (2, 4):
        for i, rows in enumerate(files[:number]):
            if number == 2 or i >= 2:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = pipelines.reference_marks(pipelines.source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1))
        pipelines.run_batches(stream, lambda batch, _: out.extend(tuple(r)[:2] for r in batch.collect()), f"{tmp_path}/checkpoint", "append")
    assert sorted(out) == [(1, 2), (2, 8), (3, 9)]
