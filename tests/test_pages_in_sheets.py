"""Pages of cells, worked out where a sheet's cells, merges and bands meet."""

from __future__ import annotations

import random

import pytest

from __spark_entry__ import queries
from quire.operators import sheets


@pytest.mark.parametrize("headers", [(0, 0), (1, 1), (2, 0), (0, 2)])
@pytest.mark.parametrize(("nested", "most"), [(False, 1_000_000), (True, 1_000_000), (False, 100)])
def test_pages_in_sheets_as_by_joins(spark, monkeypatch, headers, nested, most):
    monkeypatch.setattr(sheets, "IN_ONE_TASK", most)
    rng = random.Random(3)
    cells = [(b, "A", r, c, float(r)) for b in "xyz" for r in range(40) for c in range(6) if rng.random() < 0.5] + [("w", "A", 500, 0, 1.0)]
    rows = [(b, "A", k, 8 * k, 8 * k + 7) for b in "xyw" for k in range(5)] + ([("x", "A", 9, 3, 30), ("x", "A", 10, 4, 5)] if nested else [])
    cols = [(b, "A", k, 2 * k, 2 * k + 1) for b in "xyz" for k in range(3)]
    merges = [(b, "A", k, r := rng.randrange(38), c := rng.randrange(5), r + rng.randrange(9), c + rng.randrange(3)) for b in "xz" for k in range(12)]
    cells = spark.createDataFrame(cells, "book string, sheet string, row long, col long, num double")
    rows, cols = spark.createDataFrame(rows, "book string, sheet string, band long, r0 long, r1 long"), spark.createDataFrame(cols, "book string, sheet string, band int, c0 long, c1 long")
    merges = spark.createDataFrame(merges, "book string, sheet string, merge long, r0 long, c0 long, r1 long, c1 long")
    want = sheets._joined_pages(cells, rows, cols, merges, *headers, None)
    got = sheets.cells_to_pages(cells, rows, cols, merges, *headers)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cells_are_dealt_by_sheet_alone(spark):
    """Cells are not dealt once more by stretches of rows, nor for the numbers of pages."""
    plan = queries()["c15_merges_and_headers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_band" not in plan.replace("row_band", "").replace("col_band", "") and "dense_rank" not in plan
