"""The breaker against a plain fold: stretches of any length, composition in any grouping, over midnight."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foretide.operators.breaker import Stretch, circuit_breaker, play

CALLS = st.lists(st.tuples(st.integers(0, 120), st.sampled_from([True, False, False, False])), max_size=40).map(lambda x: sorted(x, key=lambda c: c[0]))


def _fold(calls, failures, rest, state=(0, None)):
    """The states of a breaker after all calls, by its rules."""
    failed, since = state
    for at, ok in calls:
        if since is not None and at - since < rest:
            continue
        trying = since is not None
        if ok:
            failed, since = 0, None
        elif trying or failed + 1 >= failures:
            failed, since = failures, at
        else:
            failed += 1
    return failed, since


@settings(max_examples=300, deadline=None)
@given(CALLS, st.lists(st.integers(0, 40), max_size=4), st.integers(1, 5), st.integers(1, 60), st.integers(-80, 0))
def test_composition(calls, cuts, failures, rest, since):
    cuts = [0, *sorted(min(c, len(calls)) for c in cuts), len(calls)]
    parts = [Stretch.of([a for a, _ in calls[i:j]], [ok for _, ok in calls[i:j]], failures, rest) for i, j in zip(cuts, cuts[1:], strict=False)]
    left = parts[0]
    for p in parts[1:]:
        left = left.then(p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = p.then(right)
    for state in [*((f, None) for f in range(failures)), (failures, since)]:
        want = _fold(calls, failures, rest, state)
        assert left.after(state) == right.after(state) == want


def test_calls_of_many_days(spark):
    rng, rows = random.Random(2), []
    for source, gap, good in (("a", 300, 0.3), ("b", 40, 0.1), ("c", 20_000, 0.2), (None, 900, 0.5)):
        at = 1_700_000_000
        for i in range(400):
            at += rng.choice((0, 1, rng.randint(0, 2 * gap)))
            rows.append((source, at, len(rows), rng.choice([True, False]) if rng.random() < good else False if i % 7 else None))
    df = spark.createDataFrame(rows, "source string, at_seconds long, call_id long, ok boolean")
    want = {}
    for source in ("a", "b", "c", None):
        calls = sorted((r[1], r[2], bool(r[3])) for r in rows if r[0] == source)
        states = play([c[0] for c in calls], [c[2] for c in calls], (0, None), 5, 1800)
        want |= {i: s for (_, i, _), s in zip(calls, states, strict=True)}
    assert {*want.values()} == {"CLOSED", "REFUSED", "HALF_OPEN"}
    for seconds, together in ((3600, 256), (86_400, 3), (500, 4)):
        got = {r.call_id: r.state for r in circuit_breaker(df, stretch_seconds=seconds, together=together).collect()}
        assert got == want


def test_no_calls(spark):
    assert circuit_breaker(spark.createDataFrame([], "source string, at_seconds long, call_id long, ok boolean")).count() == 0
