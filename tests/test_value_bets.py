"""What a value bet costs: the grid of a fixture is computed once."""

from __future__ import annotations

from foretide.plans import catalog


def test_grid_is_computed_once(spark, sf):
    plan = catalog.QUERIES["value_bets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("factorial(") == 2  # goals at home and away
