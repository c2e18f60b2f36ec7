"""Rule formulas as programs, run over batches of cells.

A formula is read into a postfix program, its constants and its references.
Formulas that differ in constants and places alone have one program, so a batch
is worked out program by program on arrays, whatever the number of distinct
formulas; texts are read once per task that meets them.  Referenced cells are
looked up inside their sheet; for very large sheets they come by one join on
(sheet, row, column) with a row per place of a formula.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expressions import FormulaError, parse
from quire.operators.sheets import SHEET, in_sheets
from quire.schemas import MAX_COL, MAX_ROW

EMPTY, NUMBER, TEXT, BOOL, ERROR = range(5)  # numbers before texts before truth values
KINDS = {"empty": EMPTY, "number": NUMBER, "text": TEXT, "bool": BOOL, "error": ERROR}
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
#: Arguments of the functions of the language.
FUNCTIONS = {"MOD": 2, "LEN": 1, "ROW": 0}
_PLAIN = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")

#: (postfix program, constants (kind, num, txt), references (row, col, row fixed, col fixed))
Program = tuple[tuple, tuple, tuple]


@lru_cache(maxsize=200_000)
def compiled(text: str | None) -> Program | None:
    """The program of a formula; None for one outside the language, which never fires.

    Steps are ``("c", n)`` the n-th constant, ``("r", n)`` the n-th reference, a
    comparison, or a function's name.
    """
    steps: list[tuple] = []
    constants: list[tuple] = []
    references: list[tuple] = []

    def constant(kind: int, num: float, txt: str = "") -> None:
        steps.append(("c", len(constants)))
        constants.append((kind, num, txt))

    def walk(tree: tuple) -> None:
        kind = tree[0]
        if kind == "num":
            constant(NUMBER, tree[1])
        elif kind == "neg" and tree[1][0] == "num":
            constant(NUMBER, -tree[1][1])
        elif kind == "text":
            constant(TEXT, 0.0, tree[1])
        elif kind == "bool":
            constant(BOOL, float(tree[1]))
        elif kind == "cell":
            if tree[1:] not in references:
                references.append(tree[1:])
            steps.append(("r", references.index(tree[1:])))
        elif kind == "op" and tree[1] in COMPARISONS:
            walk(tree[2])
            walk(tree[3])
            steps.append((tree[1],))
        elif kind == "call" and FUNCTIONS.get(tree[1]) == len(tree[2]):
            for argument in tree[2]:
                walk(argument)
            steps.append((tree[1],))
        else:
            raise FormulaError(f"{kind} is not part of rule formulas")

    try:
        walk(parse(text or ""))
    except (FormulaError, RecursionError):
        return None
    return tuple(steps), tuple(constants), tuple(references)


class Values:
    """Tagged values of a batch: kinds, numbers and texts side by side."""

    def __init__(self, kind: np.ndarray, num: np.ndarray, txt: np.ndarray | None = None):
        self.kind, self.num = kind, num
        self.txt = txt if txt is not None else np.full(len(kind), "", object)

    @staticmethod
    def of(kind: int, num: np.ndarray, error: np.ndarray) -> Values:
        return Values(np.where(error, ERROR, kind).astype(np.int8), num)


def _compare(a: Values, b: Values) -> tuple[np.ndarray, np.ndarray]:
    """(sign of a - b, whether they do not compare): kinds first, a blank equals 0 and the empty text, texts without case."""
    one = np.where(a.kind == EMPTY, np.where(b.kind == TEXT, TEXT, NUMBER), a.kind)
    two = np.where(b.kind == EMPTY, np.where(a.kind == TEXT, TEXT, NUMBER), b.kind)
    out = np.where(one != two, np.sign(one.astype(int) - two), np.sign(a.num - b.num))
    for k in np.flatnonzero((one == TEXT) & (two == TEXT)):
        x, y = ((v.txt[k] or "").lower() if v.kind[k] == TEXT else "" for v in (a, b))
        out[k] = (x > y) - (x < y)
    return out, (a.kind == ERROR) | (b.kind == ERROR) | np.isnan(out)


def _numbers(v: Values) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, what is none)."""
    out, bad = np.where((v.kind == NUMBER) | (v.kind == BOOL), v.num, 0.0), v.kind == ERROR
    for k in np.flatnonzero(v.kind == TEXT):
        text = (v.txt[k] or "").strip()
        bad[k] = not _PLAIN.fullmatch(text)
        out[k] = 0.0 if bad[k] else float(text)
    return out, bad


def number_text(x: float) -> str:
    """Shortest decimal text of a number, without an exponent."""
    if x == int(x):
        return str(int(x))
    text = repr(float(x))
    return np.format_float_positional(x, trim="-") if "e" in text else text


def _lengths(v: Values) -> np.ndarray:
    texts = (t or "" if k == TEXT else number_text(n) if k == NUMBER and np.isfinite(n) else ("TRUE" if n else "FALSE") if k == BOOL else "" for k, n, t in zip(v.kind.tolist(), v.num.tolist(), v.txt))
    return np.fromiter(map(len, texts), float, len(v.kind))


def run(steps: tuple, constants: list[Values], references: list[Values], rows: np.ndarray) -> Values:
    """The value of a program for each row of a batch."""
    stack: list[Values] = []
    with np.errstate(all="ignore"):
        for step in steps:
            if step[0] in ("c", "r"):
                stack.append((constants if step[0] == "c" else references)[step[1]])
            elif step[0] == "ROW":
                stack.append(Values(np.full(len(rows), NUMBER, np.int8), rows + 1.0))
            elif step[0] == "LEN":
                v = stack.pop()
                stack.append(Values.of(NUMBER, _lengths(v), v.kind == ERROR))
            elif step[0] == "MOD":
                (b, bad), (a, worse) = _numbers(stack.pop()), _numbers(stack.pop())
                stack.append(Values.of(NUMBER, a - b * np.floor(a / b), bad | worse | (b == 0)))
            else:
                b, a = stack.pop(), stack.pop()
                sign, error = _compare(a, b)
                holds = {"=": sign == 0, "<>": sign != 0, "<": sign < 0, "<=": sign <= 0, ">": sign > 0, ">=": sign >= 0}[step[0]]
                stack.append(Values.of(BOOL, holds.astype(float), error))
    (v,) = stack
    return v


_PLACES = "array<struct<row:long,col:long,fixed_row:boolean,fixed_col:boolean>>"
_ARROW_PLACES = pa.list_(pa.struct([("row", pa.int64()), ("col", pa.int64()), ("fixed_row", pa.bool_()), ("fixed_col", pa.bool_())]))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def with_places(matches: DataFrame, formula: str) -> DataFrame:
    """matches plus _refs: the references of its formula, null for one outside the language."""
    at = matches.columns.index(formula)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("row", "col", "fixed_row", "fixed_col")
        for batch in batches:
            texts = batch.column(at).dictionary_encode()
            known = [None if (p := compiled(t)) is None else [dict(zip(names, r)) for r in p[2]] for t in texts.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, _ARROW_PLACES).take(texts.indices)], names=[*batch.schema.names, "_refs"])

    return matches.mapInArrow(work, _schema(matches, f"_refs {_PLACES}"))


def _held(values: pa.Array | None, rows: np.ndarray, places: int) -> list[Values]:
    """The referenced cells of some rows of a batch, place by place."""
    if not places:
        return []
    flat = values.take(pa.array(rows)).flatten()
    kinds = np.array([KINDS.get(k, EMPTY) for k in flat.field("kind").to_pylist()], np.int8).reshape(-1, places)
    num = flat.field("num").fill_null(0.0).to_numpy(zero_copy_only=False).astype(float).reshape(-1, places)
    txt = np.array([t or "" for t in flat.field("txt").to_pylist()], object).reshape(-1, places)
    return [Values(kinds[:, k], num[:, k], txt[:, k]) for k in range(places)]


def _values(kind: pd.Series, num: pd.Series, txt: pd.Series) -> Values:
    return Values(kind.map(KINDS).fillna(EMPTY).to_numpy(np.int8), num.fillna(0.0).to_numpy(float), txt.fillna("").to_numpy(object))


def compares(operator: pd.Series, cell: Values, a: Values, b: Values) -> np.ndarray:
    """Whether cells fulfil operators on one or two values; an undefined comparison does not."""
    (to, bad), (ends, odd) = _compare(cell, a), _compare(a, b)
    swap = ends > 0
    pick = lambda x, y: Values(np.where(swap, y.kind, x.kind), np.where(swap, y.num, x.num), np.where(swap, y.txt, x.txt))
    (low, _), (high, worse) = _compare(cell, pick(a, b)), _compare(cell, pick(b, a))
    inside = (low >= 0) & (high <= 0)
    one = {"equal": to == 0, "notEqual": to != 0, "lessThan": to < 0, "lessThanOrEqual": to <= 0, "greaterThan": to > 0, "greaterThanOrEqual": to >= 0}
    out, own = np.zeros(len(operator), bool), operator.to_numpy(object)
    for name, holds in one.items():
        out |= (own == name) & holds & ~bad
    return out | ((own == "between") & inside | (own == "notBetween") & ~inside) & ~(bad | odd | worse)


def value_rule_fires(kind: Column, operator: Column, cell: Column, a: Column, b: Column) -> Column:
    """Whether a rule of a cell (struct kind, num, txt) fires: an expression whose value ``a`` is true, or a comparison with ``a`` (and ``b``)."""

    @F.pandas_udf("boolean")
    def fires(kinds: pd.Series, operators: pd.Series, cells: pd.DataFrame, first: pd.DataFrame, second: pd.DataFrame) -> pd.Series:
        held, x, y = (_values(v["kind"], v["num"], v["txt"]) for v in (cells, first, second))
        true = ((x.kind == NUMBER) | (x.kind == BOOL)) & (x.num != 0)
        return pd.Series(np.where(kinds == "expression", true, compares(operators, held, x, y)))

    return fires(kind, operator, cell, a, b)


_NAMES = np.array(list(KINDS), object)
_VALUE = pa.struct([("kind", pa.string()), ("num", pa.float64()), ("txt", pa.string())])


def values_in(texts: list[str | None], rows: np.ndarray, cells: pa.Array | None) -> pa.Array:
    """The value of each row's formula, program by program; ``cells`` are lists of the referenced cells (kind, num, txt) in their order.

    A formula outside the language is an error.
    """
    kind, num, txt = np.full(len(texts), ERROR, np.int8), np.zeros(len(texts)), np.full(len(texts), None, object)
    groups: dict[tuple, list[tuple[int, tuple]]] = {}
    for k, text in enumerate(texts):
        program = compiled(text)
        if program is not None:
            groups.setdefault((program[0], len(program[2])), []).append((k, program[1]))
    for (steps, places), members in groups.items():
        at = np.array([k for k, _ in members])
        columns = [tuple(zip(*c)) for c in zip(*(c for _, c in members))]
        constants = [Values(np.array(kind, np.int8), np.array(num, float), np.array(txt, object)) for kind, num, txt in columns]
        v = run(steps, constants, _held(cells, at, places), rows[at])
        kind[at], num[at], txt[at] = v.kind, v.num, np.where(v.kind == TEXT, v.txt, None)
    numeric = (kind == NUMBER) | (kind == BOOL)
    return pa.StructArray.from_arrays([pa.array(_NAMES[kind], pa.string()), pa.array(num, mask=~numeric), pa.array(txt, pa.string())], fields=list(_VALUE))


def tagged(cells: DataFrame) -> Column:
    """struct(kind, num, txt) of a cell; numbers and nulls where the table has no kinds."""
    kind = F.col("kind") if "kind" in cells.columns else F.when(F.col("num").isNull(), "empty").otherwise("number")
    txt = F.col("txt") if "txt" in cells.columns else F.lit(None)
    return F.struct(kind.cast("string").alias("kind"), F.col("num").cast("double").alias("num"), txt.cast("string").alias("txt"))


def expression_rules(matches: DataFrame, cells: DataFrame, formula: str = "formula1") -> DataFrame:
    """matches (row, col, the range's r0 and c0, a formula) plus fired: true or a number other than 0.

    Texts, blanks, errors, null formulas and those outside the language never
    fire; see :func:`formula_values`.
    """
    value = formula_values(matches, cells, formula, "_value")
    return value.withColumn("fired", F.coalesce(F.col("_value.kind").isin("bool", "number") & (F.col("_value.num") != 0), F.lit(False))).drop("_value")


def _worked_out(mine: pa.Table, held: pa.Table, formula: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, num and txt of the formula of each match of a sheet, their cells looked up by place."""
    number = lambda t, c: t.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    place = (number(held, "row") << 14) | number(held, "col")
    order = np.argsort(place, kind="stable")
    place = place[order]
    cells = _sorted_cells(held.column("_cell").combine_chunks(), order)
    texts = mine.column(formula).combine_chunks()
    if not pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_encode(null_encoding="encode")
    programs = [compiled(t) for t in texts.dictionary.to_pylist()]
    code = texts.indices.to_numpy()
    row, col, r0, c0 = (number(mine, c) for c in ("row", "col", "r0", "c0"))
    # Formulas of one shape run together; each has its own constants and places.
    shapes: dict[tuple, list[int]] = {}
    for k, program in enumerate(programs):
        if program is not None:
            shapes.setdefault((program[0], len(program[2])), []).append(k)
    by_code = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[by_code], np.arange(len(programs) + 1))
    kind, num, txt = np.full(len(code), ERROR, np.int8), np.zeros(len(code)), np.full(len(code), None, object)
    for (steps, places), members in shapes.items():
        at = np.concatenate([by_code[bounds[k] : bounds[k + 1]] for k in members])
        which = np.repeat(np.arange(len(members)), [bounds[k + 1] - bounds[k] for k in members])
        constants = []
        for c in zip(*(programs[k][1] for k in members)):
            kinds, numbers, words = zip(*c)
            constants.append(Values(np.array(kinds, np.int8)[which], np.array(numbers, float)[which], np.array(words, object)[which]))
        references = []
        for r in zip(*(programs[k][2] for k in members)):
            y, x, fixed_y, fixed_x = (np.array(v)[which] for v in zip(*r))
            y, x = y + np.where(fixed_y, 0, row[at] - r0[at]), x + np.where(fixed_x, 0, col[at] - c0[at])
            beyond = (y < 0) | (y > MAX_ROW) | (x < 0) | (x > MAX_COL)
            asked = (y << 14) | x
            near = np.minimum(np.searchsorted(place, asked), max(len(place) - 1, 0))
            there = (place[near] == asked) & ~beyond if len(place) else np.zeros(len(at), bool)
            references.append(_looked_up(cells, near, there, beyond))
        v = run(steps, constants, references, row[at])
        kind[at], num[at], txt[at] = v.kind, v.num, np.where(v.kind == TEXT, v.txt, None)
    return kind, num, txt


def _values_in_sheet(text_at: str) -> Callable[[pa.Table, pa.Table], pa.Array]:
    """The work of a sheet: the values of its matches' formulas."""

    def work(mine: pa.Table, held: pa.Table) -> pa.Array:
        kind, num, txt = _worked_out(mine, held, text_at)
        numeric = (kind == NUMBER) | (kind == BOOL)
        return pa.StructArray.from_arrays([pa.array(_NAMES[kind], pa.string()), pa.array(num, mask=~numeric), pa.array(txt, pa.string())], fields=list(_VALUE))

    return work


def _sorted_cells(cells: pa.StructArray, order: np.ndarray) -> Values:
    """The cells of a sheet in an order."""
    of = _in_columns(cells.field("kind"), cells.field("num"), cells.field("txt"))
    return Values(of.kind[order], of.num[order], of.txt[order])


def _looked_up(cells: Values, near: np.ndarray, there: np.ndarray, beyond: np.ndarray) -> Values:
    """The cells at some places; none is a blank, and an error beyond the sheet."""
    if there.all():
        return Values(cells.kind[near], cells.num[near], cells.txt[near])
    kind, num, txt = np.where(beyond, ERROR, EMPTY).astype(np.int8), np.zeros(len(near)), np.full(len(near), "", object)
    at = np.flatnonzero(there)
    if len(at):
        found = near[at]
        kind[at], num[at], txt[at] = cells.kind[found], cells.num[found], cells.txt[found]
    return Values(kind, num, txt)


def formula_values(matches: DataFrame, cells: DataFrame, formula: str = "formula1", name: str = "value") -> DataFrame:
    """matches (row, col, the range's r0 and c0, a formula) plus the formula's value, struct(kind, num, txt).

    Formulas hold constants, cells (absolute, or relative to the range's
    corner), comparisons, MOD, LEN and ROW().  Cells beyond the sheet, null
    formulas and those outside the language are errors.  Repeated matches stay
    repeated.  Matches and cells of a sheet meet in one task, so that no match
    is shuffled for its references; sheets too large for that are joined by place.
    """
    held = cells.select(*SHEET, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), tagged(cells).alias("_cell"))
    few, many = in_sheets(matches, held, _values_in_sheet(formula), name, "struct<kind:string,num:double,txt:string>")
    if many is None:
        return few
    large, theirs = many
    return few.unionByName(joined_values(large, theirs.select(*SHEET, "row", "col", "_cell.*"), formula, name))


#: Matches that are worked out together where rules are counted.
MATCHES_AT_ONCE = 500_000


def _counted_in_sheet(formula: str, at_once: int) -> Callable[[pa.Table, pa.Table], pa.Array]:
    """The work of a sheet: how many cells each of its rules holds, and on how many it fires; matches are made some rules at a time."""

    def work(mine: pa.Table, held: pa.Table) -> pa.Array:
        corner = lambda c, none: mine.column(c).fill_null(none).to_numpy().astype(np.int64)
        r0, r1, c0, c1 = corner("r0", 1 << 40), corner("r1", -1), corner("c0", 1 << 40), corner("c1", -1)  # a null corner holds nothing
        held = held.filter(pc.and_(held.column("row").is_valid(), held.column("col").is_valid()))
        row, col = (held.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        order = np.argsort(row, kind="stable")
        held, row, col = held.take(pa.array(order)), row[order], col[order]
        first = np.searchsorted(row, r0)
        n = np.maximum(np.searchsorted(row, r1, side="right") - first, 0)
        cells, fired = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        ends, start = np.cumsum(n), 0
        texts = mine.column(formula).combine_chunks().dictionary_encode(null_encoding="encode")
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")))
            rule = np.repeat(np.arange(start, stop), n[start:stop])
            at = np.arange(len(rule)) - np.repeat(ends[start:stop] - n[start:stop], n[start:stop]) + (ends[start - 1] if start else 0) + first[rule]
            inside = (col[at] >= c0[rule]) & (col[at] <= c1[rule])
            rule, at = rule[inside], at[inside]
            if len(rule):
                kind, num, _ = _worked_out(pa.table({"row": row[at], "col": col[at], "r0": r0[rule], "c0": c0[rule], formula: texts.take(pa.array(rule))}), held, formula)
                cells += np.bincount(rule, minlength=len(n))
                fired += np.bincount(rule[((kind == NUMBER) | (kind == BOOL)) & (num != 0)], minlength=len(n))
            start = stop
        return pa.StructArray.from_arrays([pa.array(cells), pa.array(fired)], names=["n_cells", "n_fired"])

    return work


def rule_counts(rules: DataFrame, cells: DataFrame, formula: str = "formula1", at_once: int = MATCHES_AT_ONCE) -> DataFrame:
    """rules (a range r0, c0, r1, c1 and a formula) plus n_cells, the cells in its range, and n_fired, those it fires on as in :func:`expression_rules`.

    Rules and cells of a sheet meet in one task, where the matches are made,
    worked out and counted, so that none is shuffled.  Sheets too large for
    that go by matches.
    """
    from quire.operators.rules import rule_matches

    held = cells.select(*SHEET, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), tagged(cells).alias("_cell"))
    few, many = in_sheets(rules, held, _counted_in_sheet(formula, at_once), "_n", "struct<n_cells:long,n_fired:long>")
    if many is not None:
        large, theirs = many
        theirs = theirs.select(*SHEET, "row", "col", "_cell.*")
        own = [F.col(f"`{c}`") for c in rules.columns]
        # Matches have their ranges cut to the used range; a formula's places go by the rule's own corner.
        corners = ["r0", "c0", "r1", "c1"]
        whole = large.dropna(subset=corners).distinct().withColumns({f"_{c}": F.col(c) for c in corners})
        matches = rule_matches(theirs.select(*SHEET, "row", "col"), whole).withColumns({c: F.col(f"_{c}") for c in corners}).drop(*[f"_{c}" for c in corners])
        value = joined_values(matches, theirs, formula, "_value")
        counts = value.groupBy(*own).agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(F.col("_value.kind").isin("bool", "number") & (F.col("_value.num") != 0), 1)).alias("n_fired"))
        same = functools.reduce(lambda x, y: x & y, [F.col(f"_a.`{c}`").eqNullSafe(F.col(f"_b.`{c}`")) for c in rules.columns])
        n = F.struct(F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"), F.coalesce("n_fired", F.lit(0).cast("long")).alias("n_fired"))
        few = few.unionByName(large.alias("_a").join(counts.alias("_b"), same, "left").select("_a.*", n.alias("_n")))
    return few.select(*[F.col(f"`{c}`") for c in rules.columns], "_n.*")


def _in_columns(kind: pa.Array, num: pa.Array, txt: pa.Array) -> Values:
    """Values of columns kind, num, txt; nulls are blanks, zeros and empty texts."""
    names = kind.dictionary_encode()
    known = np.array([KINDS.get(k, EMPTY) for k in names.dictionary.to_pylist()] + [EMPTY], np.int8)
    kinds = known[names.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]
    words = np.full(len(txt), "", object) if txt.null_count == len(txt) else txt.fill_null("").to_numpy(zero_copy_only=False)
    return Values(kinds, num.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), words)


def _fire_in_sheet(mine: pa.Table, held: pa.Table) -> pa.Array:
    """The work of a sheet: whether the rules of its matches fire, their formulas worked out beside each other."""
    column = lambda c: mine.column(c).combine_chunks()
    of = lambda x: _in_columns(x.field("kind"), x.field("num"), x.field("txt"))
    a = b = of(_values_in_sheet("formula1")(mine, held))
    two = column("formula2").is_valid().to_numpy(zero_copy_only=False)
    if two.any():
        at = np.flatnonzero(two)
        found = of(_values_in_sheet("formula2")(mine.take(pa.array(at)), held))
        b = Values(a.kind.copy(), a.num.copy(), a.txt.copy())
        b.kind[at], b.num[at], b.txt[at] = found.kind, found.num, found.txt
    true = ((a.kind == NUMBER) | (a.kind == BOOL)) & (a.num != 0)
    own = _in_columns(column("_kind"), column("num"), column("txt"))
    fires = compares(column("operator").to_pandas(), own, a, b)
    return pa.array(np.where(column("kind").to_pandas() == "expression", true, fires))


def formula_rules(matches: DataFrame, cells: DataFrame) -> DataFrame:
    """matches of expressions and comparisons (kind, operator, formula1, formula2 or null, the cell's _kind, num, txt) plus fired.

    A sheet's formulas are worked out in one meeting of its matches and cells;
    sheets too large for that go value by value (:func:`joined_values`).
    """
    held = cells.select(*SHEET, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), tagged(cells).alias("_cell"))
    few, many = in_sheets(matches, held, _fire_in_sheet, "fired", "boolean")
    if many is None:
        return few
    large, theirs = many
    theirs = theirs.select(*SHEET, "row", "col", "_cell.*")
    one = joined_values(large, theirs, "formula1", "_a")
    both = joined_values(one.where("formula2 IS NOT NULL"), theirs, "formula2", "_b").unionByName(one.where("formula2 IS NULL").withColumn("_b", F.col("_a")))
    own = F.struct(F.col("_kind").alias("kind"), F.col("num").cast("double").alias("num"), "txt")
    return few.unionByName(both.withColumn("fired", value_rule_fires(F.col("kind"), F.col("operator"), own, F.col("_a"), F.col("_b"))).drop("_a", "_b"))


def joined_values(matches: DataFrame, cells: DataFrame, formula: str = "formula1", name: str = "value") -> DataFrame:
    """:func:`formula_values` by one join on (sheet, row, column), for sheets of any size."""
    own = [F.col(f"`{c}`") for c in matches.columns]
    asked = with_places(matches, formula)
    text_at, row_at = matches.columns.index(formula), matches.columns.index("row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = values_in(batch.column(text_at).to_pylist(), batch.column(row_at).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], batch.column(batch.num_columns - 1), found], names=[*batch.schema.names[:-2], "_n", name])

    worked_out = lambda df: df.mapInArrow(work, _schema(matches, "_n int", f"`{name}` struct<kind:string,num:double,txt:string>"))
    none = asked.where("_refs IS NULL").select(*own, F.lit(1).alias("_n"), F.struct(F.lit("error").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("txt")).alias(name))
    one = asked.where("_refs IS NOT NULL").select(*own, F.size("_refs").alias("_places"), F.posexplode_outer("_refs").alias("_place", "_ref"))
    to = lambda axis, corner: F.col(f"_ref.{axis}") + F.when(F.col(f"_ref.fixed_{axis}"), 0).otherwise(F.col(axis) - F.col(corner))
    one = one.withColumns({"_row": to("row", "r0"), "_col": to("col", "c0")}).drop("_ref")
    held = cells.select(*[F.col(c).alias(f"_{c}_") for c in SHEET], F.col("row").alias("_at"), F.col("col").alias("_by"), tagged(cells).alias("_cell"))
    met = one.where("_places > 0").join(held, (one["_row"] == held["_at"]) & (one["_col"] == held["_by"]) & (one[SHEET[0]] == held[f"_{SHEET[0]}_"]) & (one[SHEET[1]] == held[f"_{SHEET[1]}_"]), "left")
    beyond = ~F.col("_row").between(0, MAX_ROW) | ~F.col("_col").between(0, MAX_COL)
    value = F.struct(F.when(beyond, "error").otherwise(F.coalesce("_cell.kind", F.lit("empty"))).alias("kind"), F.col("_cell.num").alias("num"), F.col("_cell.txt").alias("txt"))
    bare = one.where("_places = 0").select(*own, F.array().cast("array<struct<kind:string,num:double,txt:string>>").alias("_values"), F.lit(1).alias("_n"))
    single = met.where("_places = 1").select(*own, F.array(value).alias("_values"), F.lit(1).alias("_n"))
    # A match of several places is put together again; equal matches have equal places several times.
    several = met.where("_places > 1").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("_place", value.alias("cell")))).alias("_cells"))
    copies = F.size(F.filter("_cells", lambda x: x["_place"] == 0))
    several = several.select(*own, copies.alias("_n"), "_cells").select(*own, F.transform(F.filter("_cells", lambda x, i: i % F.col("_n") == 0), lambda x: x["cell"]).alias("_values"), "_n")
    done = worked_out(bare).unionByName(worked_out(single)).unionByName(none)
    again = worked_out(several).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_copy")
    return done.unionByName(again).drop("_n")
