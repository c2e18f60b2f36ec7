"""Tables that were read from packages don't go through the driver."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("name", ["w1_styled_workbooks", "f2_nested_tables"])
def test_tables_of_packages_are_not_broadcast(spark, name):
    """Spark takes them for small ones, as it knows only the size of the tables that the packages were made from."""
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
