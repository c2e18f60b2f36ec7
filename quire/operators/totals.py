"""Totals of many boxes of cells, without a row per cell and box.

Cells are added up in blocks of 4, 16, 64 ... rows (and 16, 256 ... columns).  A
box is cut into the largest blocks that lie inside it, a few per level, so the
work follows the number of cells and boxes, however large the boxes are and
however often they overlap (``SUM(A$1:A9)`` in every row).  Unlike differences
of running sums, blocks serve least and greatest values too and lose no digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.sheets import SHEET, in_sheets

BOX = ["r0", "c0", "r1", "c1"]
#: Rows and columns of a block of the next level.
ROWS, COLS = 4, 16
#: So many pieces of boxes (about 100 bytes each) are broadcast at most, so that cells stay where they are.
BROADCAST_PIECES = 200_000


def _levels(last: int, radix: int) -> int:
    """Levels of blocks that a line of places 0 to ``last`` can fill."""
    n = 1
    while radix**n <= last + 1:
        n += 1
    return n


def pieces(low: Column, high: Column, radix: int, levels: int) -> Column:
    """array of struct(level, block): the largest blocks that make up ``low`` to ``high``."""
    size = [radix**k for k in range(levels)]
    begin = [F.ceil(low / s) for s in size] + [F.lit(0).cast("long")]
    end = [F.floor((high + 1) / s) for s in size] + [F.lit(0).cast("long")]  # exclusive
    at_level = lambda run, k: F.transform(run, lambda x: F.struct(F.lit(k).alias("level"), x.alias("block")))
    parts = []
    for k in range(levels):
        # blocks of this level between the box's border and the blocks of the next level
        inner = begin[k + 1] < end[k + 1]
        left = F.when(inner, F.least(begin[k + 1] * radix, end[k])).otherwise(end[k])
        right = F.when(inner, F.greatest(end[k + 1] * radix, begin[k])).otherwise(end[k])
        for a, b in ((begin[k], left), (right, end[k])):
            run = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))
            parts.append(at_level(run, k))
    return F.concat(*parts)


def box_totals(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct boxes (book, sheet, r0, c0, r1, c1) with the total, low, high and stored of the numbers in them, and bad.

    ``cells`` are (book, sheet, row, col, num, bad); ``bad`` is the least text
    that is no number.  Boxes without cells are left out.
    """
    tall, wide, n = boxes.agg(F.max(F.col("r1") - F.col("r0")), F.max(F.col("c1") - F.col("c0")), F.count(F.lit(1))).first()
    n_rows, n_cols = _levels(tall or 0, ROWS), _levels(wide or 0, COLS)
    asked = boxes.select(*SHEET, *BOX).distinct()
    asked = asked.select(*SHEET, *BOX, F.explode(pieces(F.col("r0"), F.col("r1"), ROWS, n_rows)).alias("_y"))
    asked = asked.select(*SHEET, *BOX, "_y", F.explode(pieces(F.col("c0"), F.col("c1"), COLS, n_cols)).alias("_x"))
    key = ["_ky", "_y", "_kx", "_x"]
    most = n * min((tall or 0) + 1, 2 * (ROWS - 1) * n_rows) * min((wide or 0) + 1, 2 * (COLS - 1) * n_cols)
    asked = asked.select(*SHEET, *BOX, F.col("_y.level").alias("_ky"), F.col("_y.block").alias("_y"), F.col("_x.level").alias("_kx"), F.col("_x.block").alias("_x"))
    sums = lambda df: df.groupBy(*SHEET, *key).agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("stored").alias("stored"), F.min("bad").alias("bad"))
    values = ["total", "low", "high", "stored", "bad"]

    def grown(df: DataFrame, first: int, last: int) -> DataFrame:
        """Blocks of some levels of rows and all of columns from those of level ``first`` of rows."""
        grid = F.array(*[F.struct(F.lit(a).alias("_ky"), F.lit(b).alias("_kx"), F.lit(ROWS ** (a - first)).alias("h"), F.lit(COLS**b).alias("w")) for a in range(first, last) for b in range(n_cols)])
        wide = df.select(*SHEET, "_y", "_x", *values, F.explode(grid).alias("_g"))
        return wide.select(*SHEET, "_g._ky", F.floor(F.col("_y") / F.col("_g.h")).alias("_y"), "_g._kx", F.floor(F.col("_x") / F.col("_g.w")).alias("_x"), *values)

    one = cells.select(*SHEET, F.lit(0).alias("_ky"), F.col("row").alias("_y"), F.lit(0).alias("_kx"), F.col("col").alias("_x"), F.col("num").alias("total"), F.col("num").alias("low"), F.col("num").alias("high"), F.when(F.col("num").isNotNull(), 1).otherwise(0).alias("stored"), "bad")
    if most <= BROADCAST_PIECES:
        # Few pieces: one pass over the cells, of whose blocks only those go on that a box has.
        asked = F.broadcast(asked)
        block = sums(grown(one, 0, n_rows).join(F.broadcast(asked.select(*SHEET, *key).distinct()), [*SHEET, *key], "left_semi"))
    else:
        block = sums(grown(one, 0, 1)) if n_cols > 1 else one
        if n_rows > 1:  # the blocks of the first level are a quarter of the cells, and all others come from them
            block = block.unionByName(sums(grown(sums(one.withColumn("_y", F.floor(F.col("_y") / ROWS))), 1, n_rows)))
    met = block.join(asked, [*SHEET, *key])
    return met.groupBy(*SHEET, *BOX).agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("stored").alias("stored"), F.min("bad").alias("bad"))


_TOTALS = pa.struct([("total", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("stored", pa.int64()), ("bad", pa.string())])
_AT_ONCE = 1_000_000
_JOIN = (np.add, np.minimum, np.maximum, np.add, np.minimum)
_NOTHING = (0.0, np.inf, -np.inf, 0, np.iinfo(np.int64).max)


def _tree(leaves: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Values of 1, 2, 4 ... neighbours, level by level."""
    levels = [leaves]
    while len(levels[-1][0]) > 1:
        half = len(levels[-1][0]) // 2 * 2
        levels.append([f(v[0:half:2], v[1:half:2]) for f, v in zip(_JOIN, levels[-1])])
    return levels


def _stretches(levels: list[list[np.ndarray]], low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Values of the stretches from ``low`` to before ``high``, each from the largest blocks inside it."""
    low, high = low.copy(), high.copy()
    out = [np.full(len(low), x) for x in _NOTHING]
    for values in levels:
        if not (low < high).any():
            break
        for end in (0, 1):
            at = np.flatnonzero((low < high) & (((high if end else low) & 1) == 1))
            if end:
                high[at] -= 1
            place = (high if end else low)[at]
            for f, o, v in zip(_JOIN, out, values):
                o[at] = f(o[at], v[place])
            if not end:
                low[at] += 1
        low >>= 1
        high >>= 1
    return out


def _totals_in_sheet(rows: pa.Table, cells: pa.Table) -> pa.StructArray:
    """The totals of each row's box from the cells of its sheet."""
    number = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    row, col = number(cells, "row"), number(cells, "col")
    order = np.lexsort((row, col))
    place = (col[order] << 20) | row[order]
    given = cells.column("num").combine_chunks()
    there = given.is_valid().to_numpy(zero_copy_only=False)[order]
    num = given.fill_null(0.0).to_numpy(zero_copy_only=False)[order]
    texts = cells.column("bad").combine_chunks().dictionary_encode()
    words = texts.dictionary.to_pylist()
    rank = {w: k for k, w in enumerate(sorted(words, key=str.encode))}
    code = np.full(len(order), _NOTHING[4])
    if words:
        mine = texts.indices.fill_null(-1).to_numpy(zero_copy_only=False)[order]
        code = np.where(mine >= 0, np.array([rank[w] for w in words], np.int64)[mine], code)
    levels = _tree([np.where(there, num, 0.0), np.where(there, num, np.inf), np.where(there, num, -np.inf), there.astype(np.int64), code])
    columns = np.unique(col)
    r0, c0, r1, c1 = (number(rows, c) for c in BOX)
    first = np.searchsorted(columns, c0)
    n = np.maximum(np.searchsorted(columns, c1, "right") - first, 0)
    out = [np.full(rows.num_rows, x) for x in _NOTHING]
    # As many boxes at once as have about so many columns together.
    cuts = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + _AT_ONCE, _AT_ONCE)), rows.num_rows))
    for a, b in zip(np.append(0, cuts), cuts):
        own = np.flatnonzero(n[a:b]) + a
        if not len(own):
            continue
        starts = np.cumsum(n[own]) - n[own]
        box = np.repeat(own, n[own])
        at = columns[np.arange(len(box)) - np.repeat(starts, n[own]) + first[box]] << 20
        values = _stretches(levels, np.searchsorted(place, at | np.clip(r0[box], 0, (1 << 20) - 1), "left"), np.searchsorted(place, at | np.clip(r1[box], 0, (1 << 20) - 1), "right"))
        for f, o, v in zip(_JOIN, out, values):
            o[own] = f.reduceat(v, starts)
    total, low, high, stored, bad = out
    none = stored == 0
    least = pa.array(sorted(words, key=str.encode), pa.string()).take(pa.array(np.where(bad == _NOTHING[4], 0, bad), mask=bad == _NOTHING[4]))
    return pa.StructArray.from_arrays([pa.array(total, mask=none), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(stored), least], fields=list(_TOTALS))


def with_totals(rows: DataFrame, cells: DataFrame, name: str = "totals") -> DataFrame:
    """rows (book, sheet, r0, c0, r1, c1 and more, boxes as often as they come) plus ``name``: struct(total, low, high, stored, bad) of the cells in its box.

    Rows and cells of a sheet meet in one task, where a box is made up of the
    largest blocks of a tree; no piece of a box is shuffled.  Sheets too large
    for that take :func:`box_totals`.
    """
    kind = "struct<total:double,low:double,high:double,stored:bigint,bad:string>"
    few, many = in_sheets(rows, cells.select(*SHEET, "row", "col", "num", "bad"), _totals_in_sheet, name, kind)
    if many is None:
        return few
    large, held = many
    got = box_totals(large, held).withColumn(name, F.struct("total", "low", "high", F.col("stored").cast("long").alias("stored"), "bad")).select(*SHEET, *BOX, name)
    return few.unionByName(large.join(got, [*SHEET, *BOX], "left").select(*rows.columns, name))
