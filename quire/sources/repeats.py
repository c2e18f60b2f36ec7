"""Repeat counts of sheets as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of a sheet.
MAX_ROWS, MAX_COLS, MAX_CELLS = 1_048_576, 16_384, 1_048_576
_SHEET = ["book", "sheet"]
_VALUES = ("kind", "num", "txt", "formula")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with a value at their first row and column (r0, c0), and whether their whole sheet is inside the limits."""
    starts = rows.select(*_SHEET, "row_ord", "row_repeat").distinct().withColumn("r0", F.coalesce(F.sum("row_repeat").over(W.partitionBy(*_SHEET).orderBy("row_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(starts.drop("row_repeat"), [*_SHEET, "row_ord"])
    held = [c for c in _VALUES if c in rows.columns and c != "kind"]
    filled = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in held])
    placed = placed.withColumn("c0", F.coalesce(F.sum("col_repeat").over(W.partitionBy(*_SHEET, "row_ord").orderBy("cell_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(filled)
    whole = W.partitionBy(*_SHEET)
    limit = (
        F.when(F.max(F.col("r0") + F.col("row_repeat")).over(whole) > MAX_ROWS, "rows").when(F.max(F.col("c0") + F.col("col_repeat")).over(whole) > MAX_COLS, "columns")
        .when(F.sum(F.col("row_repeat") * F.col("col_repeat")).over(whole) > MAX_CELLS, "cells")
    )
    return placed.withColumn("_limit", limit)


def expand_repeats(rows: DataFrame) -> DataFrame:
    """Cells (book, sheet, row, col, and what rows have of kind, num, txt, formula) of rows (row_ord, row_repeat, cell_ord, col_repeat).

    Empty cells advance the position only.  A sheet over a limit is left out
    as a whole, before anything is expanded; :func:`repeat_warnings` lists it.
    """
    ok = _placed(rows).where("_limit IS NULL")
    row = ok.withColumn("row", F.explode(F.sequence("r0", F.col("r0") + F.col("row_repeat") - 1)))
    return row.withColumn("col", F.explode(F.sequence("c0", F.col("c0") + F.col("col_repeat") - 1))).select(*_SHEET, "row", "col", *[c for c in _VALUES if c in rows.columns])


def repeat_warnings(rows: DataFrame) -> DataFrame:
    """book, sheet, warning: sheets that :func:`expand_repeats` leaves out, and the limit that they break (rows, columns or cells)."""
    return _placed(rows).where("_limit IS NOT NULL").select(*_SHEET, F.col("_limit").alias("warning")).distinct()


def span_merges(rows: DataFrame) -> DataFrame:
    """book, sheet, r0, c0, r1, c1: cells that span others (row_span, col_span), in sheets inside the limits."""
    wide = _placed(rows).where("_limit IS NULL AND (row_span > 1 OR col_span > 1)")
    return wide.select(*_SHEET, "r0", "c0", (F.col("r0") + F.col("row_span") - 1).alias("r1"), (F.col("c0") + F.col("col_span") - 1).alias("c1"))
