"""A circuit breaker over a history of calls, as a composition of functions.

What a breaker does with a call depends on what it let through before, so a history is a fold. But a stretch of calls as a whole is a
function from the state before it to the state after it, and such functions compose in any grouping: stretches are
summed up side by side, their functions are put together in order, and each stretch is then played from the state it really
begins in. States are closed with a number of failures, or open since an instant. For open states the function is a step
function of that instant: the first call that comes late enough tries, and all goes on from there. Most tries lead to the same
end, so there are few steps.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: (failures in a row, the instant since which it is open or None)
State = tuple[int, int | None]


class Stretch:
    """The function of a stretch of calls. closed: the state after it by the number of failures before; steps: (until, state after) in
    order, for states open since s: the first step with s + rest <= until holds, and beyond the last one nothing changes."""

    def __init__(self, closed: list[State], steps: list[tuple[int, State]], rest: int) -> None:
        self.closed, self.rest, self.steps = closed, rest, []
        for until, state in steps:
            if self.steps and self.steps[-1][1] == state:
                self.steps.pop()
            self.steps.append((until, state))
        self.ends = [until for until, _ in self.steps]

    @classmethod
    def of(cls, at: list[int], ok: list[bool], failures: int, rest: int) -> Stretch:
        """From its calls, by their instants in order: what follows each call is known when those after it are."""
        n = len(at)
        closed: list[State] = [(f, None) for f in range(failures)]
        tried: list[State] = [(0, None)] * n  # the state at the end if call i is let through by an open breaker
        for i in range(n - 1, -1, -1):
            if ok[i]:
                tried[i] = closed[0]
                closed = [closed[0]] * failures
            else:
                later = bisect_left(at, at[i] + rest)
                opened: State = tried[later] if later < n else (failures, at[i])
                tried[i] = opened
                closed = [*closed[1:], opened]
        return cls(closed, [(at[i], tried[i]) for i in range(n) if not i or at[i] != at[i - 1]], rest)

    def after(self, state: State) -> State:
        failed, since = state
        if since is None:
            return self.closed[failed]
        at = bisect_left(self.ends, since + self.rest)
        return self.steps[at][1] if at < len(self.steps) else state

    def then(self, other: Stretch) -> Stretch:
        """This stretch and a later one, as one."""
        last = self.ends[-1] if self.ends else None
        steps = [(until, other.after(state)) for until, state in self.steps]
        steps += [step for step in other.steps if last is None or step[0] > last]
        return Stretch([other.after(x) for x in self.closed], steps, self.rest)


def play(at: list[int], ok: list[bool], state: State, failures: int, rest: int) -> Iterator[str]:
    """What happens to each call from a state on."""
    failed, since = state
    for t, good in zip(at, ok, strict=True):
        if since is not None and t - since < rest:
            yield "REFUSED"
            continue
        yield "CLOSED" if since is None else "HALF_OPEN"
        failed = 0 if good else failures if since is not None else failed + 1
        since = t if failed >= failures else None


_STATE = "struct<failed:int,since:long>"
_STRETCH = f"closed array<{_STATE}>, steps array<struct<until:long,failed:int,since:long>>"


def _packed(stretch: Stretch) -> dict:
    return {"closed": [{"failed": f, "since": s} for f, s in stretch.closed], "steps": [{"until": u, "failed": f, "since": s} for u, (f, s) in stretch.steps]}


def _unpacked(row, rest: int) -> Stretch:
    whole = lambda x: None if x is None or x != x else int(x)
    state = lambda x: (int(x["failed"]), whole(x["since"]))
    return Stretch([state(x) for x in row.closed], [(int(x["until"]), state(x)) for x in row.steps], rest)


_CLOSED = pa.list_(pa.struct([("failed", pa.int32()), ("since", pa.int64())]))
_STEPS = pa.list_(pa.struct([("until", pa.int64()), ("failed", pa.int32()), ("since", pa.int64())]))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(source, stretch), instants, ids, ok and the state before, of each stretch of rows that come in order."""
    key, at, ids, ok, state = None, [], [], [], None
    for batch in batches:
        for name, stretch, t, i, good, *before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (name, stretch) != key:
                if key is not None:
                    yield key, at, ids, ok, [state]
                key, at, ids, ok, state = (name, stretch), [], [], [], tuple(before)
            at.append(t)
            ids.append(i)
            ok.append(good)
    if key is not None:
        yield key, at, ids, ok, [state]


def _bundles(items: Iterator, size: int) -> Iterator[list]:
    items = iter(items)
    while some := list(islice(items, size)):
        yield some


def circuit_breaker(calls: DataFrame, failures: int = 5, rest_seconds: int = 1800, stretch_seconds: int = 3600, together: int = 256) -> DataFrame:
    """source, call_id, state of calls (source, at_seconds, call_id, ok): whether each was let through (T-11). After `failures` in a row a
    source rests, refusing calls; then one call tries, which closes the breaker or lets it rest again.

    Calls are put in order by at_seconds, then call_id. A task holds the calls of a source in one stretch of time, or the functions of
    `together` stretches, or a row for each so many stretches of a source. An ok of null is a failure; calls without an instant
    are left out.
    """
    columns = ["source", F.floor(F.col("at_seconds") / stretch_seconds).alias("stretch"), F.col("at_seconds").cast("long").alias("at_seconds"), "call_id", F.coalesce("ok", F.lit(False)).alias("ok")]
    keyed = calls.filter("at_seconds IS NOT NULL").select(*columns)
    in_stretches = lambda df: df.repartition("source", "stretch").sortWithinPartitions("source", "stretch", "at_seconds", "call_id")
    kinds = {f.name: f.dataType for f in keyed.schema.fields}
    source, call_id = f"source {kinds['source'].simpleString()}", f"call_id {kinds['call_id'].simpleString()}"
    of_source, of_call = (to_arrow_type(kinds[c]) for c in ("source", "call_id"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _bundles(_stretches(batches), 256):
            made = [_packed(Stretch.of(at, ok, failures, rest_seconds)) for _, at, _, ok, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, *_ in some], of_source), pa.array([k[1] for k, *_ in some], pa.int64()), pa.array([x["closed"] for x in made], _CLOSED), pa.array([x["steps"] for x in made], _STEPS)], ["source", "stretch", "closed", "steps"])

    def played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), at, ids, ok, rest in _stretches(batches):
            states = list(play(at, ok, rest[0], failures, rest_seconds))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), of_source), pa.array(ids, of_call), pa.array(states, pa.string())], ["source", "call_id", "state"])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for row in rows.sort_values("stretch").itertuples():
            one = _unpacked(row, rest_seconds)
            whole = one if whole is None else whole.then(one)
        return pd.DataFrame([{"source": rows["source"].iloc[0], "span": rows["span"].iloc[0], **_packed(whole)}])

    def begun(column: str):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows, out = rows.sort_values(column), []
            state: State = (0, None)
            if "failed" in rows:
                since = rows["since"].iloc[0]
                state = (int(rows["failed"].iloc[0]), None if since is None or since != since else int(since))
            for row in rows.itertuples():
                out.append((row.source, getattr(row, column), *state))
                state = _unpacked(row, rest_seconds).after(state)
            return pd.DataFrame(out, columns=["source", column, "failed", "since"]).astype({"since": "Int64"})

        return run

    stretches = in_stretches(keyed).mapInArrow(summed, f"{source}, stretch long, {_STRETCH}")
    stretches = stretches.withColumn("span", F.floor(F.col("stretch") / together))
    spans = stretches.groupBy("source", "span").applyInPandas(composed, f"{source}, span long, {_STRETCH}")
    span_starts = spans.groupBy("source").applyInPandas(begun("span"), f"{source}, span long, failed int, since long")
    # sources of null are one source: joined as such
    met = lambda a, b, by: a.join(b.withColumnsRenamed({"source": "of", by: f"of_{by}"}), F.col("source").eqNullSafe(F.col("of")) & (F.col(by) == F.col(f"of_{by}"))).drop("of", f"of_{by}")
    starts = met(stretches, span_starts, "span").groupBy("source", "span").applyInPandas(begun("stretch"), f"{source}, stretch long, failed int, since long")
    return in_stretches(met(keyed, starts, "stretch")).mapInArrow(played, f"{source}, {call_id}, state string")
