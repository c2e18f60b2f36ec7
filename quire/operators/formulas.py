"""Formulas, sorting, pivots and charts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.expressions import FormulaError, parse, references
from quire.functions.scalars import coerce_number, range_parse
from quire.lineage import checkpoint
from quire.operators.sheets import SHEET
from quire.operators.totals import with_totals
from quire.ordering import in_groups, in_order

#: References to more cells than this stay one range.
MAX_EXPANDED = 10_000
_REF = r"(\$?[A-Za-z]{1,3}\$?[0-9]{1,7}(?::\$?[A-Za-z]{1,3}\$?[0-9]{1,7})?)(?![A-Za-z0-9_(])"


def formula_refs(formulas: DataFrame) -> DataFrame:
    """formula_id and the cells (row, col) it refers to, strings left out, ranges expanded; larger ranges keep r1, c1."""
    bare = F.regexp_replace("formula", '"[^"]*"', "")
    ref = formulas.select("formula_id", F.explode(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_$])" + _REF), F.lit(1))).alias("ref")).select("formula_id", range_parse(F.col("ref")).alias("b")).where("b IS NOT NULL")
    area = (F.col("b.r1") - F.col("b.r0") + 1) * (F.col("b.c1") - F.col("b.c0") + 1)
    small = ref.where(area <= MAX_EXPANDED).select("formula_id", F.explode(F.sequence("b.r0", "b.r1")).alias("row"), "b").select("formula_id", "row", F.explode(F.sequence("b.c0", "b.c1")).alias("col")).withColumns({"r1": F.col("row"), "c1": F.col("col")})
    large = ref.where(area > MAX_EXPANDED).select("formula_id", F.col("b.r0").alias("row"), F.col("b.c0").alias("col"), F.col("b.r1").alias("r1"), F.col("b.c1").alias("c1"))
    return small.unionByName(large).distinct()


def _numbers_of(cells: DataFrame) -> DataFrame:
    """book, sheet, row, col, num and bad (a text that is no number); a text of a number is one, a blank text is 0."""
    txt = (F.col("txt") if "txt" in cells.columns else F.lit(None)).cast("string")
    num = F.coalesce(F.col("num").cast("double"), F.when(F.trim(txt) == "", F.lit(None)).otherwise(coerce_number(txt)))
    return cells.select(*SHEET, "row", "col", num.alias("num"), F.when(num.isNull() & (F.trim(txt) != ""), txt).alias("bad"))


def range_aggregate(formulas: DataFrame, cells: DataFrame, count_blanks: bool = True) -> DataFrame:
    """formulas (formula_id, fn, box) with value and error: SUM, AVERAGE, MIN, MAX or COUNT over their range.

    Blanks count as 0 and are counted (``count_blanks``): the area less the
    stored cells, never rows of their own.  A text (``txt``, where cells have
    it) that is no number makes the value null and is the ``error``.
    """
    got = with_totals(formulas, _numbers_of(cells), "_t")
    out = got.select(*formulas.columns, F.col("_t.total").alias("s"), F.col("_t.stored").alias("n"), F.col("_t.low").alias("lo"), F.col("_t.high").alias("hi"), F.col("_t.bad").alias("_bad"))
    area = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    n = F.coalesce("n", F.lit(0))
    blanks = (area - n) if count_blanks else F.lit(0)
    total, s = n + blanks, F.coalesce("s", F.lit(0.0))
    with_zero = lambda x, f: F.when(blanks > 0, f(F.coalesce(x, F.lit(0.0)), F.lit(0.0))).otherwise(x)
    value = F.when(F.col("fn") == "SUM", s).when(F.col("fn") == "AVERAGE", F.try_divide(s, total)).when(F.col("fn") == "COUNT", total.cast("double")).when(F.col("fn") == "MIN", with_zero(F.col("lo"), F.least)).when(F.col("fn") == "MAX", with_zero(F.col("hi"), F.greatest))
    return out.withColumns({"value": F.when(F.col("_bad").isNull(), value), "error": F.col("_bad")}).drop("s", "n", "lo", "hi", "_bad")


def running_totals(cells: DataFrame) -> DataFrame:
    """cells plus total: the sum of the column from its top, as one window instead of growing ranges."""
    return cells.withColumn("total", F.sum("num").over(W.partitionBy(*SHEET, "col").orderBy("row")))


def _whole_or_text(num: Column) -> Column:
    return F.when((num == F.floor(num)) & (F.abs(num) < 1e15), num.try_cast("long").cast("string")).otherwise(num.cast("string"))


def _annuity(rate: Column, periods: Column, due: Column) -> tuple[Column, Column]:
    """(growth over all periods, worth at the end of one paid each period)."""
    growth = F.pow(1 + rate, periods)
    return growth, F.when(rate == 0, periods).otherwise((1 + rate * due) * (growth - 1) / F.nullif(rate, F.lit(0.0)))


def _call(name: str, x: list[Column]) -> Column:
    arg = lambda i: x[i] if i < len(x) else F.lit(0.0)
    if name == "ABS":
        return F.abs(arg(0))
    if name == "ROUND":
        factor = F.pow(F.lit(10.0), arg(1))
        return F.floor(arg(0) * factor + 0.5) / factor
    if name in ("PMT", "FV", "PV"):
        growth, worth = _annuity(arg(0), arg(1), arg(4))
        if name == "PMT":
            return -F.try_divide(arg(2) * growth + arg(3), worth)
        if name == "FV":
            return -(arg(3) * growth + arg(2) * worth)
        return -F.try_divide(arg(3) + arg(2) * worth, growth)
    many = {"SUM": lambda: sum(x[1:], x[0]), "AVERAGE": lambda: sum(x[1:], x[0]) / len(x), "COUNT": lambda: F.lit(float(len(x))), "MIN": lambda: F.least(*x) if len(x) > 1 else x[0], "MAX": lambda: F.greatest(*x) if len(x) > 1 else x[0]}
    if name in many and x:
        return many[name]()
    raise FormulaError(f"unsupported function {name}")


def evaluate(formula: str, columns: dict[str, Column], texts: tuple[str, ...] = ()) -> Column:
    """Column of one formula over the columns of a row, by name of its references (blank is 0; those in ``texts`` are text columns).

    An error (a division by zero, a text that is no number) is null; a formula
    that cannot be read, with ranges or unknown functions or names, raises
    FormulaError on the driver.  :func:`evaluate_formulas` is the form for a
    table of formulas.
    """
    named = {k.upper(): v for k, v in columns.items()}

    def address(tree: tuple) -> str:
        letters, n = "", tree[2] + 1
        while n:
            n, rest = divmod(n - 1, 26)
            letters = chr(65 + rest) + letters
        return f"{letters}{tree[1] + 1}"

    def typed(tree: tuple) -> tuple[str, Column]:
        kind = tree[0]
        if kind in ("num", "text", "bool"):
            return kind, F.lit(tree[1])
        if kind == "cell":
            name = address(tree)
            if name not in named:
                raise FormulaError(f"no column for {name}")
            return "num", F.when(named[name].isNull() | (F.trim(named[name].cast("string")) == ""), F.lit(0.0)).otherwise(coerce_number(named[name].cast("string")) if name in texts else named[name].try_cast("double"))
        if kind == "neg":
            return "num", -number(tree[1])
        if kind == "percent":
            return "num", number(tree[1]) / 100
        if kind == "call":
            return "num", _call(tree[1], [number(t) for t in tree[2]])
        if kind == "op" and tree[1] == "&":
            return "text", F.concat(text(tree[2]), text(tree[3]))
        if kind == "op" and tree[1] in "+-*/^":
            a, b = number(tree[2]), number(tree[3])
            return "num", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "^": lambda: F.pow(a, b)}[tree[1]]()
        if kind == "op":
            (ka, a), (kb, b) = typed(tree[2]), typed(tree[3])
            if (ka == "text") != (kb == "text"):
                return "bool", F.lit(tree[1] == "<>")
            if ka != "text":
                a, b = number(tree[2]), number(tree[3])
            return "bool", {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree[1]]
        raise FormulaError("a range is no single number")

    def number(tree: tuple) -> Column:
        kind, value = typed(tree)
        return coerce_number(value) if kind == "text" else value.cast("double")

    def text(tree: tuple) -> Column:
        kind, value = typed(tree)
        return value if kind == "text" else F.when(value, "true").otherwise("false") if kind == "bool" else _whole_or_text(value)

    return typed(parse(formula))[1]


class _Range:
    """What is known of the cells of a range: blanks count as 0 and are counted."""

    def __init__(self, total: float, low: float | None, high: float | None, stored: int, area: int, bad: str | None):
        self.total, self.area, self.bad = total, area, bad
        blank = stored < area
        self.low = min(low if low is not None else 0.0, 0.0) if blank or low is None else low
        self.high = max(high if high is not None else 0.0, 0.0) if blank or high is None else high


def _js_text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)
    return v


def _number_of(v) -> float:
    if isinstance(v, _Range):
        raise FormulaError("a range is no single number")
    if isinstance(v, str):
        plain = "".join(v.split()).replace(",", ".", 1)
        try:
            value = float(plain or 0)
        except ValueError:
            value = math.inf
        if not math.isfinite(value) or "_" in plain:
            raise FormulaError(f"{v!r} is no number")
        return value
    return float(v)


def _worth(name: str, x: list) -> float:
    """Functions on plain numbers and ranges."""
    if name in ("SUM", "AVERAGE", "MIN", "MAX", "COUNT"):
        for r in x:
            if isinstance(r, _Range) and r.bad is not None:
                raise FormulaError(f"{r.bad!r} is no number")
        parts = [(r.total, r.area, r.low, r.high) if isinstance(r, _Range) else (_number_of(r), 1, _number_of(r), _number_of(r)) for r in x]
        count = sum(p[1] for p in parts)
        if not count and name != "SUM" and name != "COUNT":
            raise FormulaError(f"{name} of nothing")
        return {"SUM": lambda: sum(p[0] for p in parts), "AVERAGE": lambda: sum(p[0] for p in parts) / count, "MIN": lambda: min(p[2] for p in parts), "MAX": lambda: max(p[3] for p in parts), "COUNT": lambda: count}[name]()
    n = [_number_of(v) for v in x] + [0.0] * 5
    if name == "ABS":
        return abs(n[0])
    if name == "ROUND":
        return math.floor(n[0] * 10.0 ** n[1] + 0.5) / 10.0 ** n[1]
    if name in ("PMT", "FV", "PV"):
        rate, periods, a, b, due = n[:5]
        growth = (1 + rate) ** periods
        paid = periods if rate == 0 else (1 + rate * due) * (growth - 1) / rate
        if name == "PMT" and periods == 0:
            raise FormulaError("no periods")
        return {"PMT": lambda: -(a * growth + b) / paid, "FV": lambda: -(b * growth + a * paid), "PV": lambda: -(b + a * paid) / growth}[name]()
    raise FormulaError(f"unsupported function {name}")


def _result(tree: tuple, held: dict[str, object]):
    """Value of a tree; ``held`` has the references by :func:`_key`."""
    kind = tree[0]
    if kind in ("num", "text", "bool"):
        return tree[1]
    if kind in ("cell", "range"):
        value = held[_key(tree)]
        if isinstance(value, FormulaError):
            raise value
        return value
    if kind in ("neg", "percent"):
        value = _number_of(_result(tree[1], held))
        return -value if kind == "neg" else value / 100
    if kind == "call":
        return float(_worth(tree[1], [_result(t, held) for t in tree[2]]))
    sign, a, b = tree[1], _result(tree[2], held), _result(tree[3], held)
    if sign == "&":
        if isinstance(a, _Range) or isinstance(b, _Range):
            raise FormulaError("a range is no text")
        return _js_text(a) + _js_text(b)
    if sign in "+-*/^":
        x, y = _number_of(a), _number_of(b)
        if sign == "/" and y == 0:
            raise FormulaError("division by zero")
        value = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "^": lambda: x**y}[sign]()
        if isinstance(value, complex):
            raise FormulaError("no real number")
        return value
    a, b = (v if isinstance(v, str) else _number_of(v) for v in (a, b))
    if isinstance(a, str) != isinstance(b, str):
        return sign == "<>"
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def _key(tree: tuple) -> str:
    return ":".join(map(str, tree[1:5] if tree[0] == "range" else (tree[1], tree[2], tree[1], tree[2])))


def evaluate_formulas(formulas: DataFrame, cells: DataFrame) -> DataFrame:
    """formulas (book, sheet, formula_id, formula) plus kind (number, text, bool or error), num and txt.

    References are cells of the formula's sheet; a blank one is 0, a text is
    read as a number, and one that is none is an error, in ranges too.  Errors
    are rows with the reason in ``txt``.  Spark brings the values together:
    references are joined to the cells they cover and summed up per reference,
    so a range costs one row however many cells it has.
    """
    key = [*SHEET, "formula_id"]
    ref_type = "array<struct<ref:string,r0:long,c0:long,r1:long,c1:long>>"

    @F.pandas_udf(ref_type)
    def refs_of(column: pd.Series) -> pd.Series:
        def one(text):
            try:
                return [{"ref": _key(t), **dict(zip(("r0", "c0", "r1", "c1"), t[1:5] if t[0] == "range" else (t[1], t[2], t[1], t[2])))} for t in references(parse(text))]
            except FormulaError:
                return []

        return column.map(lambda text: one(text or ""))

    asked = formulas.select(*key, F.explode(refs_of("formula")).alias("x")).select(*key, "x.*")
    area = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    known = with_totals(asked.withColumn("area", area), _numbers_of(cells), "_t").select(*key, "ref", "area", "_t.*")
    held = known.groupBy(*key).agg(F.collect_list(F.struct("ref", "total", "low", "high", F.coalesce("stored", F.lit(0)).alias("stored"), "area", "bad")).alias("_held"))  # the references of one formula

    @F.pandas_udf("struct<kind:string,num:double,txt:string>")
    def worked_out(text: pd.Series, values: pd.Series) -> pd.DataFrame:
        def one(formula, found):
            try:
                tree = parse(formula or "")
                at = {}
                for x in found if found is not None else ():
                    bad = x["bad"]
                    at[x["ref"]] = _Range(x["total"] or 0.0, x["low"], x["high"], x["stored"], x["area"], bad)
                single = {_key(t) for t in references(tree) if t[0] == "cell"}
                for k in single:
                    r = at[k]
                    at[k] = FormulaError(f"{r.bad!r} is no number") if r.bad is not None else float(r.total)
                v = _result(tree, at)
                if isinstance(v, _Range):
                    raise FormulaError("a range is no result")
                if isinstance(v, bool):
                    return "bool", float(v), None
                return ("text", None, v) if isinstance(v, str) else ("number", float(v), None)
            except (FormulaError, OverflowError, ZeroDivisionError) as e:
                return "error", None, str(e)

        rows = [one(*x) for x in zip(text, values)]
        return pd.DataFrame(rows, columns=["kind", "num", "txt"])

    out = formulas.join(held, key, "left").withColumn("_x", worked_out("formula", "_held"))
    return out.select(*formulas.columns, "_x.*")


def autosum_ranges(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """targets (row, col) plus r0..c1: the run of numbers right above, else right left, else null."""
    numbers = cells.where("num IS NOT NULL").select(*SHEET, "row", "col")
    up, left = W.partitionBy(*SHEET, "col"), W.partitionBy(*SHEET, "row")
    isl = numbers.withColumns({"_v": F.col("row") - F.row_number().over(up.orderBy("row")), "_h": F.col("col") - F.row_number().over(left.orderBy("col"))})
    isl = isl.withColumns({"top": F.min("row").over(W.partitionBy(*SHEET, "col", "_v")), "first": F.min("col").over(W.partitionBy(*SHEET, "row", "_h"))})
    above = isl.select(*SHEET, (F.col("row") + 1).alias("row"), "col", "top")
    beside = isl.select(*SHEET, "row", (F.col("col") + 1).alias("col"), "first")
    out = targets.join(above, [*SHEET, "row", "col"], "left").join(beside, [*SHEET, "row", "col"], "left")
    has_top, has_first = F.col("top").isNotNull(), F.col("first").isNotNull()
    pick = lambda a, b: F.when(has_top, a).when(has_first, b)
    return out.select(*SHEET, "row", "col", pick(F.col("top"), F.col("row")).alias("r0"), pick(F.col("col"), F.col("first")).alias("c0"), pick(F.col("row") - 1, F.col("row")).alias("r1"), pick(F.col("col"), F.col("col") - 1).alias("c1"))


def _accents() -> tuple[str, str]:
    """Lower-case letters with marks up to U+1EFF and the plain letters that they are made of."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x1F00)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and c == c.lower() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accents()


def natural_key(text: Column) -> Column:
    """Sort key of text: lower case, no accents, digit runs filled to 20 digits."""
    folded = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), ACCENTED, PLAIN)
    parts = F.regexp_extract_all(folded, F.lit(r"(\d+|\D+)"), F.lit(1))
    filled = F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(p, 20, "0")).otherwise(p)), "")
    return F.when(F.rlike(folded, F.lit(r"\d")), filled).otherwise(folded)


def sort_range(rows: DataFrame, key: str, by: list[str], index: str, desc: bool = False) -> DataFrame:
    """rows plus position (from 0) in the range ``by``: blanks last, numbers before texts, ties by index; a very large range is dealt out over tasks."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    num = coerce_number(text)
    blank = F.trim(text) == ""
    natural = F.when(num.isNull() & ~blank, natural_key(text))
    order = [blank.cast("int"), *([num.isNotNull().cast("int"), num.desc_nulls_last(), natural.desc()] if desc else [num.isNull().cast("int"), num.asc_nulls_last(), natural.asc()]), F.col(index)]
    return in_groups(rows, by, order)


def table_headers(headers: DataFrame) -> DataFrame:
    """headers (table_id, position, text) plus name: trimmed, a default for blanks, repeats (any case) with the smallest free number from 2.

    Names depend on those before them in the same table, which is one row of a sheet.
    """
    import pandas as pd

    def name(frame: pd.DataFrame) -> pd.DataFrame:
        frame, used, names = frame.sort_values("position"), set(), []
        free: dict[str, int] = {}  # numbers below are taken for good, so none is tried twice
        for position, text in zip(frame["position"].tolist(), frame["text"].tolist()):
            base = (text or "").strip() or f"Column{position + 1}"
            own, k = base, free.get(base.lower(), 2)
            while own.lower() in used:
                own, k = f"{base}{k}", k + 1
            free[base.lower()] = k
            used.add(own.lower())
            names.append(own)
        return frame.assign(name=names)

    return headers.select("table_id", "position", "text").groupBy("table_id").applyInPandas(name, "table_id long, position long, text string, name string")


def table_name(text: Column, table_id: Column) -> Column:
    """Name of a table: trimmed, TableN for a blank one, ``_`` for all but letters, digits, ``_`` and ``.``; null if it would start with a digit."""
    given = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s+|\s+$", "")
    base = F.when(given == "", F.concat(F.lit("Table"), table_id.cast("string"))).otherwise(given)
    name = F.regexp_replace(base, r"[^\p{L}\p{N}_.]", "_")
    return F.when(~F.rlike(name, F.lit(r"^[0-9]")), name)


def pivot_summary(rows: DataFrame, group: str, values: list[str], order: str, blank: str = "(blank)") -> DataFrame:
    """Per group and in total: rows, and per value column the sum if *every* row of it is a number, else the row count.

    Groups are in first-seen order (``position``); the total has position -1.
    """
    numbers = {v: coerce_number(F.col(v).cast("string")) for v in values}
    name = F.trim(F.coalesce(F.col(group), F.lit("")))
    keyed = rows.select(F.when(name == "", F.lit(blank)).otherwise(name).alias("grp"), F.col(order).alias("_o"), *[n.alias(v) for v, n in numbers.items()])
    # One pass over the rows; what is left is a row per group, summed up on its own.
    groups = checkpoint(keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_o").alias("_o"), *[F.sum(v).alias(v) for v in values], *[F.count(v).alias(f"_n_{v}") for v in values]))
    total = groups.agg(F.sum("n_rows").alias("n_rows"), *[F.sum(v).alias(v) for v in values], *[F.sum(f"_n_{v}").alias(f"_n_{v}") for v in values]).where("n_rows > 0")
    one = total.select(*[(F.col(f"_n_{v}") == F.col("n_rows")).alias(f"_{v}") for v in values]).first()
    whole = {v: bool(one and one[f"_{v}"]) for v in values}
    shown = [(F.col(v) if whole[v] else F.col("n_rows").cast("double")).alias(v) for v in values]
    own = in_order(groups, "_o", "grp").select("grp", "n_rows", *shown, "position")
    return own.unionByName(total.select(F.lit(None).cast("string").alias("grp"), "n_rows", *shown, F.lit(-1).cast("long").alias("position")))


def chart_series(rows: DataFrame, chart: list[str], order: str, category: str | None, value: str) -> DataFrame:
    """rows plus idx (from 0), category (its own or 1..n) and value (blank is 0)."""
    idx = F.row_number().over(W.partitionBy(*chart).orderBy(order)) - 1
    name = F.col(category).cast("string") if category else (idx + 1).cast("string")
    return rows.select(*chart, idx.cast("long").alias("idx"), name.alias("category"), F.coalesce(coerce_number(F.col(value).cast("string")), F.lit(0.0)).alias("value"))


def chart_axis(series: DataFrame, chart: list[str], with_zero: bool) -> DataFrame:
    """Five ticks (tick 0..4, at) per chart between the extremes of all values, flat ranges widened by 0.5 each way."""
    low, high = F.min("value"), F.max("value")
    if with_zero:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    ends = series.groupBy(*chart).agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n"))
    flat = F.col("low") == F.col("high")
    ends = ends.withColumns({"low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")), "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))})
    ticks = ends.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return ticks.select(*chart, F.col("tick").cast("long").alias("tick"), F.round(F.col("low") + (F.col("high") - F.col("low")) * F.col("tick") / 4, 2).alias("at"), F.ceil(F.col("n") / 6).cast("long").alias("label_step"))


def pie_shares(series: DataFrame, chart: list[str]) -> DataFrame:
    """share and start and end angle (from -pi/2) of each positive value; ``idx`` stays the colour index."""
    import math

    shown = series.where("value > 0")
    total = F.sum("value").over(W.partitionBy(*chart))
    upto = F.sum("value").over(W.partitionBy(*chart).orderBy("idx"))
    angle = lambda x: F.lit(-math.pi / 2) + x / total * (2 * math.pi)
    return shown.select(*chart, "idx", (F.col("value") / total).alias("share"), angle(upto - F.col("value")).alias("start"), angle(upto).alias("end"))


def reorder_units(units: DataFrame, order: DataFrame, group: list[str]) -> DataFrame:
    """units (index) at their new place by order (position, index); groups whose order is no full permutation are left out."""
    n = units.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    good = order.groupBy(*group).agg(F.count(F.lit(1)).alias("m"), F.countDistinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi")).join(n, group).where("m = n AND d = n AND lo = 0 AND hi = n - 1").select(*group)
    return units.join(order, [*group, "index"]).join(good, group, "left_semi")


