"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from foretide.plans import catalog
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:  # likeness of names is no SQL: tests/test_parsers.py holds these against brute force
        assert name in ("identity_scores", "identity_resolve", "feed_picks") and len(got)
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n.startswith("stream_")])
def test_streams_of_folders(spark, sf, duck, name, tmp_path):
    """The table as a folder of several files, the latest events in the first of them."""
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", ascending=False)
    events.coalesce(1).write.option("maxRecordsPerFile", len(events.collect()) // 4).parquet(f"{tmp_path}/events.parquet")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 3
    assert rows_of(got) == rows_of(want)
