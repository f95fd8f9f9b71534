"""What versions known at an instant cost: each row that asks is dealt out as one row."""

from __future__ import annotations

from foretide.plans import catalog


def test_rows_are_not_multiplied(spark, sf):
    plan = catalog.QUERIES["versions_known"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate " not in plan and plan.count("Join ") == 1
