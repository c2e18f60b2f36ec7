"""Rules counted where they meet their cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quire.operators import rules, sheets

RULES = "book string, sheet string, rule long, r0 long, c0 long, r1 long, c1 long, formula1 string"


@pytest.mark.parametrize(("most", "at_once"), [(1_000_000, 7), (1_000_000, 500_000), (10, 500_000)])
def test_rules_are_counted_as_by_matches(spark, monkeypatch, most, at_once):
    """Also some rules at a time, and for sheets that are too large for one task; equal rules count apart."""
    rng = random.Random(5)
    cells = [(b, "A", r, c, rng.choice([None, 0.5, 2.0, 25.0, 1e-9, rng.random()])) for b in "xyz" for r in range(30) for c in range(4) if rng.random() < 0.4] + [("w", "A", 0, 0, 1.0)]
    formulas = ["=A1>1", "=LEN(A1)>4", "=MOD(ROW(),3)=1", "=$B$2<B1", "=FOO(1)", None, "=A1"]
    rows = [(b, "A", k, r := rng.randrange(25), c := rng.randrange(3), rng.choice([r + 4, 1048575, r - 1]), c + rng.randrange(3), rng.choice(formulas)) for b in "xyzv" for k in range(25)]
    rows += [rows[0], rows[1], ("x", "A", 90, 0, 0, 1048575, 3, "=A1>1"), ("x", "A", 90, 0, 0, 1048575, 3, "=A1>1"), ("x", "A", 91, None, 0, 5, 3, "=A1>1")]
    cells, rule = spark.createDataFrame(cells, "book string, sheet string, row long, col long, num double"), spark.createDataFrame(rows, RULES)
    fired = rules.expression_rules(sheets.in_ranges(cells, rule), cells)
    want = fired.groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(F.col("fired"), 1)).alias("n_fired")).collect()
    monkeypatch.setattr(sheets, "IN_ONE_TASK", most)
    counted = rules.rule_counts(rule, cells, at_once=at_once)
    assert counted.count() == len(rows)
    got = counted.groupBy(*rule.columns).agg(F.sum("n_cells").alias("n_cells"), F.sum("n_fired").alias("n_fired")).where("n_cells > 0").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("name", ["d5_expression", "d5_distinct_formulas"])
def test_matches_are_not_shuffled(spark, name):
    """No formula crosses a shuffle with its cells, and no orders go through the driver."""
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_band" not in plan and "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") <= 8
